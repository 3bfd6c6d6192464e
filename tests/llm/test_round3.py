"""Archive conversion, fill-in-the-middle and collocations against brute force, round trips and known answers."""

import gzip
import hashlib
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackmill.llm import collocations, fill_in_middle, warc

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

# fill-in-the-middle

ODD = ["", " ", "\n\t ", "one", "one two", " one  two ", "éa ñ 漢字 🙂🙂 x", "🙂", "é" * 50 + " " + "漢 " * 30, "a<P>b c", "<S>", "x <M> y", "a\x00b \x1f c", "<", "<S", "a <S b S> c", "   x y", "ß " * 400]


def dealt(text, doc_id, unit):
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = TOKEN.findall(text) if unit == "token" else list(text)
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return text, n, "plain", None, None, None, None
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return out[1], n, out[0], len(p), len(m), len(p.encode()), len(m.encode())


@pytest.mark.parametrize("unit", ["token", "char"])
def test_fill_in_middle(spark, unit):
    rows = [(i * len(ODD) + j, x) for i in range(12) for j, x in enumerate(ODD)]
    docs = spark.createDataFrame([*rows, (5, None), (None, "a b c"), (7, "twice"), (7, "twice")], "doc_id long, text string")
    out = fill_in_middle.fill_in_middle(docs, unit=unit).withColumn("back", fill_in_middle.restored(F.col("text"), F.col("form"))).collect()
    want = [dealt(x, i, unit) for i, x in rows] + [dealt("", 5, unit), dealt("a b c", "null", unit), *[dealt("twice", 7, unit)] * 2]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[1:-1] for r in out], key=key) == sorted(want, key=key)
    assert sorted(r.back for r in out) == sorted([x for _, x in rows] + ["", "a b c", "twice", "twice"])
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_cuts_convert_both_ways():
    for text in [*ODD, "é漢🙂a" * 1000]:
        raw, cuts = text.encode(), fill_in_middle.Cuts(text.encode())
        assert cuts.n_chars == len(text)
        for c in range(0, len(text) + 1, max(1, len(text) // 97)):
            at = len(text[:c].encode())
            assert (cuts.to_bytes(c), cuts.to_chars(at)) == (at, c)
        assert len(cuts.byte_at) == sum(len(c.encode()) > 1 for c in text)
        assert [raw[a:b].decode() for a, b in zip([0, *fill_in_middle.token_ends(raw)], fill_in_middle.token_ends(raw))] == TOKEN.findall(text)


def test_fill_in_middle_extremes(spark):
    long = "漢字 word " * 300_000
    docs = spark.createDataFrame([(i, x, "n", 3) for i, x in enumerate([long, " " * 1_000_000, "z" * 1_000_000])], "doc_id long, text string, n string, Raw int")
    out = fill_in_middle.fill_in_middle(docs, rate=100)
    assert out.columns == ["doc_id", "text", "n", "Raw", "_n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes"]
    back = out.withColumn("back", fill_in_middle.restored(F.col("text"), F.col("form"))).orderBy("doc_id").collect()
    assert [r.back for r in back] == [long, " " * 1_000_000, "z" * 1_000_000] and [r["_n"] for r in back] == [600_001, 1, 1] and "plain" not in {r.form for r in back}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(docs, unit="byte")


# archives


def arcs(folder, **files):
    os.makedirs(folder)
    for name, content in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)
    return str(folder)


def arc(version, *records, origin=b"test"):
    fields = b" ".join(x.encode() for x in warc.ARC_FIELDS[version])
    block = b"%d 0 %s\n%s\n" % (version, origin, fields)
    more = b" 200 - - 0 a.arc" if version == 2 else b""
    out = b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain%s %d\n%s\n" % (more, len(block), block)
    for url, date, mime, block in records:
        out += b"%s 10.1.2.3 %s %s%s %d\n%s\n" % (url, date, mime, more.replace(b"200", b"404"), len(block), block)
    return out


HTTP = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"


def test_arc_versions_are_read_by_their_fields(spark, tmp_path):
    one = [(b"http://a/x y", b"20010203040506", b"text/html", HTTP + b"http://b 1.2.3.4 20010101000000 text/html 5\nhello"), (b"dns:a", b"2001020304", b"text/dns", b"a 10.1.2.3\n"), (b"http://e/", b"19991231235959", b"text/html", HTTP)]
    members = b"".join(gzip.compress(x) for x in (arc(2, *one)[:90], arc(2, *one)[90:]))
    folder = arcs(tmp_path / "a", v1=arc(1, *one), v2=arc(2, *one), gz=members, bare=b"http://z/ 1.1.1.1 20010203040506 text/html 3\nabc", empty=b"")
    rows = warc.read_arc(spark, folder).collect()
    for name, version, code in (("v1", 1, None), ("v2", 2, 404), ("gz", 2, 404)):
        own = sorted((r for r in rows if r.archive == name), key=lambda r: r.offset)
        assert [r.url for r in own] == ["filedesc://a.arc", "http://a/x y", "dns:a", "http://e/"]
        assert {r.version for r in own} == {version} and {r.result_code for r in own[1:]} == {code} and {r.problem for r in own} == {None}
        assert [bytes(r.payload) for r in own[1:]] == [one[0][3][len(HTTP) :], b"a 10.1.2.3\n", b""] and [r.head is None for r in own[1:]] == [False, True, False]
        whole = arc(version, *one)
        assert all(whole[r.offset :].startswith(r.url.encode() + b" ") for r in own)
    assert [(r.url, bytes(r.payload), r.version) for r in rows if r.archive == "bare"] == [("http://z/", b"abc", 1)]


def test_damaged_archives(spark, tmp_path):
    whole = arc(1, (b"http://a/", b"20010203040506", b"text/html", HTTP + b"x" * 500), (b"http://b/", b"20010203040506", b"text/html", HTTP + b"y" * 500))
    folder = arcs(tmp_path / "a", cut=whole[:-100], junk=whole + b"no header at all\nmore\n", gz=gzip.compress(whole)[:-40], far=arc(1, (b"http://a/", b"20010203040506", b"text/html", b"q")) + b"http://c/ 1.1.1.1 20010203040506 text/html 99999999999\nrest")
    rows = warc.read_arc(spark, folder).collect()
    told = {name: [(r.url, r.problem) for r in sorted(rows, key=lambda r: r.offset) if r.archive == name][-1] for name in ("cut", "junk", "far")}
    assert told == {"cut": ("http://b/", "truncated"), "junk": (None, "not a header line"), "far": ("http://c/", "truncated")}
    assert any(r.archive == "gz" and r.problem for r in rows)
    out = str(tmp_path / "w")
    warc.arc_to_warc(spark, folder, out)
    back = warc.read_warc(spark, out).collect()
    assert {r.problem for r in back} == {None} and {r.truncated for r in back} == {None, "length"}
    assert sum(r.warc_type is not None for r in back) == sum(r.url is not None for r in rows)


def test_warc_fields(spark, tmp_path):
    body = b"same payload " * 20
    records = [(b"http://a/", b"20010203040506", b"text/html", HTTP + body), (b"http://b/", b"200102", b"text/html", HTTP + body), (b"http://c/", b"19990230000000", b"text/html", HTTP + body), (b"ftp://d", b"20240229", b"text/plain", body)]
    folder, out = arcs(tmp_path / "a", one=arc(1, *records)), str(tmp_path / "w")
    warc.arc_to_warc(spark, folder, out)
    text = b"".join(gzip.decompress(open(f"{out}/{f}", "rb").read()) for f in os.listdir(out) if f.endswith(".gz"))
    assert text.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n") and text.count(b"WARC/1.0\r\n") == 5 and text.endswith(b"\r\n\r\n")
    back = {r.target_uri: r for r in warc.read_warc(spark, out).collect()}
    assert {k: (r.warc_type, r.warc_date) for k, r in back.items() if k} == {
        "http://a/": ("response", "2001-02-03T04:05:06Z") if back["http://a/"].warc_type == "response" else ("revisit", "2001-02-03T04:05:06Z"),
        "http://b/": (back["http://b/"].warc_type, "1970-01-01T00:00:00Z"),
        "http://c/": (back["http://c/"].warc_type, "1970-01-01T00:00:00Z"),
        "ftp://d": ("resource", "2024-02-29T00:00:00Z"),
    }
    kinds = Counter(r.warc_type for r in back.values())
    assert kinds == {"warcinfo": 1, "response": 1, "revisit": 2, "resource": 1}
    first = next(r for r in back.values() if r.warc_type == "response")
    for r in back.values():
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
        if r.warc_type == "revisit":
            assert (r.refers_to, r.payload_bytes, r.declared_digest, bytes(r.head)) == (first.record_id, 0, first.declared_digest, HTTP)
    assert first.declared_digest == first.payload_digest == hashlib.sha256(body).hexdigest()
    digests = [m.decode() for m in re.findall(rb"WARC-Block-Digest: sha256:([0-9a-f]+)", text)]
    assert hashlib.sha256(HTTP + body).hexdigest() in digests and hashlib.sha256(body).hexdigest() in digests


def test_pages_through_archives(spark, tmp_path):
    body = "<p>" + "ä" * 60
    given = [(9, "http://a/", body), (4, None, body), (4, None, body), (5, "http://x y/\n\t", body), (None, "http://n/", body), (1, "u", None), (2, "u", ""), (3, "", "x" * 99), (6, "u", "x" * 99), (7, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "\r\n\r\nWARC/1.0\r\n\r\n" * 9), (11, "u", "z" * 3_000_000), (12, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in given], "page_id long, url string, html string, record string, ID int").repartition(3)
    a, w = str(tmp_path / "a"), str(tmp_path / "w")
    warc.write_arc(pages, a)
    versions = {r.version for r in warc.read_arc(spark, a).select("version").collect()}
    assert versions == {1, 2}
    warc.arc_to_warc(spark, a, w)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.pages_of(warc.read_warc(spark, w)).collect()), key=str)
    want = []
    for i, (page, _, html) in enumerate(given):
        raw = (html or "").encode()
        same = [(p is None, p or 0, j) for j, (p, _, h) in enumerate(given) if (h or "").encode() == raw]
        first = min(same)
        again = len(raw) >= 100 and first[2] != i
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[1] if again else None))
    assert got == sorted(want, key=str)
    empty, w = str(tmp_path / "e"), str(tmp_path / "ew")
    warc.write_arc(pages.limit(0), empty)
    warc.arc_to_warc(spark, empty, w)
    assert warc.pages_of(warc.read_warc(spark, w)).count() == 0


def test_many_copies_of_one_payload_and_other_bytes(spark, tmp_path):
    raw = HTTP + bytes(range(256)) * 2
    folder = arcs(tmp_path / "a", one=arc(2, *[(b"http://a/%d" % i, b"20010203040506", b"text/html", raw) for i in range(700)], (b"http://b/", b"20010203040506", b"image/png", bytes(range(255, -1, -1)))))
    warc.arc_to_warc(spark, folder, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert Counter(r.warc_type for r in back) == {"warcinfo": 1, "response": 1, "revisit": 699, "resource": 1}
    assert {bytes(r.payload) for r in back if r.warc_type in ("response", "resource")} == {raw[len(HTTP) :], bytes(range(255, -1, -1))}
    assert all(r.payload_digest == r.declared_digest for r in back if r.warc_type == "response")


# collocations


def mined(rows, min_count, max_words, top, absorb=100):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    c = counts.setdefault(lang, Counter())
                    c[tuple(words[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        often = {p: n for p, n in c.items() if n >= min_count}
        gone = {p[i : i + j] for p, n in often.items() for j in range(2, len(p)) for i in range(len(p) - j + 1) if 100 * n >= absorb * c[p[i : i + j]]}
        own = []
        for p, a in often.items():
            if len(p) > 1 and p not in gone:
                score, k, l, r = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])]
    return sorted(out)


def prose(seed, n, size=40):
    import random

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(size)]
    fixed = ["new york city hall", "an ever so long phrase here", "ha ha ha ha ha ha"]
    out = []
    for _ in range(n):
        x = []
        while len(x) < 60:
            x += [rng.choice(fixed)] if rng.random() < 0.1 else rng.choices(words, [1 / (i + 1) for i in range(size)], k=3)
        out.append("".join(w.upper() + rng.choice([" ", "\t", "  ", " ", ", ", ".", "\n", " ! "]) if rng.random() < 0.2 else w + " " for w in x))
    return out


@pytest.mark.parametrize("shards, limit", [(1, None), (3, None), (4, None), (3, 0), (3, 60)])
def test_collocations_equal_brute_force(spark, shards, limit):
    rows = [("en", x) for x in prose(1, 60)] + [("de", x) for x in prose(2, 40)] + [(None, x) for x in prose(3, 20)] + [("und", "a b a b"), ("en", None), ("en", ""), ("xx", " ,. ")] + [("fr", "copie de la même page")] * 30
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, min_count=20, top=30, shards=shards, broadcast_active=limit).collect())
    assert got == mined(rows, 20, 5, 30)


def test_collocations_absorb_and_shorter_phrases(spark):
    rows = [("en", x) for x in prose(7, 60)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "lang string, text string, phrase string, H int")
    got = sorted(tuple(r) for r in collocations.collocations(docs, min_count=15, max_words=3, absorb_percent=60, top=10**6).collect())
    assert got == mined(rows, 15, 3, 10**6, absorb=60)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0


def test_long_texts_are_counted_across_chunks(spark, monkeypatch):
    words = " ".join(prose(9, 30)).replace(",", "").replace(".", "").replace("\n", " ").replace("!", "")
    monkeypatch.setattr(collocations, "SPLIT", 100)
    raw = words.encode()
    assert [w for part in collocations.words_of(raw) for w in part] == raw.lower().split()
    counter = collocations._Counter("en", 0, 1, 5, None)
    found = Counter()
    for part in collocations.words_of(raw):
        counter.add(part)
        for batch in counter.flush():
            for phrase, n in zip(batch.column(1).to_pylist(), batch.column(7).to_pylist()):
                found[phrase.decode()] += n
    own = raw.lower().decode().split()
    assert found == Counter(" ".join(own[i : i + k]) for k in range(1, 6) for i in range(len(own) - k + 1))


def test_exact_scores_beyond_64_bits(spark):
    row = spark.sql("SELECT cast(9000000000000 as long) a, cast(90000000000000 as long) n, cast(9100000000000 as long) l, cast(9200000000000 as long) r")
    d = lambda c: F.col(c).cast("decimal(19,0)")
    got = row.withColumn("above", (d("a") * d("n")) * F.lit(1000).cast("decimal(4,0)")).withColumn("below", d("l") * d("r")).selectExpr("above div below AS s").first().s
    assert got == 1000 * 9000000000000 * 90000000000000 // (9100000000000 * 9200000000000)


def test_one_very_long_word_and_text(spark):
    docs = spark.createDataFrame([("en", "x" * 5_000_000 + " a b"), ("en", "a b " * 400_000), ("en", "a b" + " " * 5_000_000)], "lang string, text string")
    rows = {r.phrase: r for r in collocations.collocations(docs, max_words=2).collect()}
    assert (rows["a b"].a, rows["b a"].a, rows["a b"].n) == (400_002, 399_999, 800_005)
