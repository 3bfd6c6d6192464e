"""The queries of this package and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import collocations, exact_dedup, fill_in_middle, license_scan, line_dedup, mixing, packing, pii, quality, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_quality_perplexity": quality.query,
    "op2_license_scan": license_scan.query,
    "op3_line_dedup": line_dedup.query,
    "op4_pii_surrogates": pii.query,
    "op5_best_fit_packing": packing.query,
    "op6_simhash": simhash.query,
    "op7_toxicity": toxicity.query,
    "op8_source_mixing": mixing.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_url_filter": url_filter.query,
    "op11_arc_to_warc": warc.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_collocations": collocations.query,
}

ORACLES = {
    "op2_license_scan": license_scan.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_url_filter": url_filter.SQL,
    "op11_arc_to_warc": warc.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_collocations": collocations.SQL,
}
