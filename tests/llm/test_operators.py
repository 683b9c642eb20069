"""Training-data operators against brute force, round trips and held-out accuracy, with the odd inputs."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, html_extract, jaccard, langid, quality, sharding, suffix_dedup, topk, warc
from fleetlens.llm import sentencepiece_fst as sp

SCHEMA = "doc_id long, text string, lang string, sid long, a string, key string"
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (5, "two words"), (None, "a row without an id at all"), (6, "Ünïcode ß 漢字 🙂 text"), (7, "x" * 5000), (8, "same words again and again " * 400), (9, "... !!! 123"), (10, "same words again and again " * 400)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", 1, "clash", "clash") for i, t in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def near_copies(seed=3, groups=8, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    passage = [rng.choice(vocabulary) for _ in range(25)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10_000)}"
            if rng.random() < 0.3:
                copy[10:10] = passage
            rows.append((len(rows), " ".join(copy)))
    return rows


def brute_components(rows, n, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and both:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc if doc is not None else -1, len(sets[i]), least.get(find(i), doc) if least.get(find(i), doc) is not None else -1) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, n, percent):
    rows = near_copies() + [(1000 + k, t) for k, (_, t) in enumerate(near_copies(5)[:20])]
    got = jaccard.jaccard_components(frame(spark, rows), n, percent).collect()
    assert sorted(tuple(r) for r in got) == brute_components(rows, n, percent)


def test_jaccard_odd_rows(odd, empty):
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in jaccard.jaccard_components(odd, 3, 90).collect())
    assert got == brute_components(ODD, 3, 90)
    assert jaccard.jaccard_components(empty, 3, 90).count() == 0


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        out.append((len(t), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [6, 24])
def test_repeats_equal_brute_force(spark, length):
    rng = random.Random(length)
    parts = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 60))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    rows += [(100, "ab" * 100), (101, None), (102, ""), (3, rows[3][1]), (103, "z" * length)]
    got = suffix_dedup.without_repeats(frame(spark, rows), length, with_text=False, whole_characters=False).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_repeats([(t or "").encode() for _, t in rows], length))


def test_repeats_odd_rows(odd, empty):
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(odd, 400).collect()}
    assert got[7].n_removed == 5000 and got[8].kept_text == "" and got[6].kept_text == ODD[7][1] and got[1].n_bytes == 0
    assert suffix_dedup.without_repeats(empty, 400).count() == 0
    spans = [{"first": 1, "end": 4}, {"first": 3, "end": 7}]
    assert suffix_dedup._kept("aébcdéf".encode(), suffix_dedup.merged("aébcdéf".encode(), spans, "byte"), True)[0].decode("utf-8")


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        w = (text or "").lower().split()
        for item, t in items:
            b = t.lower().split()
            for k in range(-len(b), len(w)):
                e = [0 <= k + j < len(w) and w[k + j] == b[j] for j in range(len(b))]
                fits = [0 <= k + j < len(w) for j in range(len(b))]
                if len(b) >= 13:
                    best = max((sum(e[s : s + 13]) for s in range(len(b) - 12) if all(fits[s : s + 13])), default=0)
                    if best >= 11:
                        out.add((d, item))
                elif len(b) >= 5 and all(e):
                    out.add((d, item))
    return out


def test_leaks_tolerate_substitutions(spark, odd, empty):
    rng = random.Random(1)
    word = lambda: f"t{rng.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([13, 15, 20, 40, 7, 5, 4, 12])]
    docs = []
    for i in range(120):
        own = [word() for _ in range(rng.randrange(0, 40))]
        leak = rng.choice(items)[1].split()
        leak = leak[rng.randrange(0, 3) :]
        for _ in range(rng.randrange(0, 4)):
            leak[rng.randrange(len(leak))] = "changed"
        docs.append((i, " ".join(own[: len(own) // 2] + leak + own[len(own) // 2 :])))
    bench = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    want = brute_leaks(docs, items)
    for most in (decontaminate.BROADCAST_SEEDS, 1):
        got = decontaminate.leaks(frame(spark, docs), bench, broadcast_seeds=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(odd, bench).count() == len(ODD)


def test_pieces_equal_the_library(spark, odd, empty):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    t = sp.Transducer(sp.model_bytes(spark))
    rng = random.Random(4)
    texts = [x or "" for _, x in ODD] + ["".join(rng.choice("ab  thein\nor漢🙂.%é") for _ in range(rng.randrange(1, 50))) for _ in range(1500)]
    for x in texts:
        ids = t.encode(x)
        assert ids == reference.encode(x) and t.decode(ids) == x
    got = sp.encoded(odd, sp.model_bytes(spark))
    assert got.filter("not round_trip").count() == 0 and got.count() == len(ODD)
    back = sp.decoded(got, sp.model_bytes(spark), into="again").filter("again <> coalesce(text, '')")
    assert back.count() == 0 and sp.encoded(empty, sp.model_bytes(spark)).count() == 0


def test_unigram_path_is_cheapest():
    def message(*fields):
        out = b""
        for number, kind, body in fields:
            out += bytes([number << 3 | kind]) + (bytes([len(body)]) if kind == 2 else b"") + body
        return out

    import struct

    piece = lambda p, s, t=1: (1, 2, message((1, 2, p.encode()), (2, 5, struct.pack("<f", s)), (3, 0, bytes([t]))))
    model = message(piece("<unk>", 0, 2), piece("a", -2.0), piece("b", -2.0), piece("ab", -3.0), piece("abb", -9.0), (2, 2, message((3, 0, b"\x01"))), (3, 2, message((3, 0, b"\x00"), (4, 0, b"\x00"))))
    assert sp.Transducer(model).encode("abb") == [3, 2]


@pytest.mark.parametrize("count", [1, 40])
def test_shards(spark, odd, empty, count):
    rng = random.Random(2)
    rows = [(i, "hot text") for i in range(300)] + [(1000 + i, "w " * rng.randrange(1, 400)) for i in range(600)] + ODD
    got = sharding.pack_shards(frame(spark, rows), count, rows_per_bucket=100).toPandas()
    assert len(got) == len(rows) and got["shard"].between(0, count - 1).all()
    per = got.groupby("shard").agg(bytes=("size", "sum"), n=("slot", "count"), top=("slot", "max"), distinct=("slot", "nunique"))
    assert (per["top"] + 1 == per["n"]).all() and (per["distinct"] == per["n"]).all()
    if count > 1:
        again = sharding.pack_shards(frame(spark, rows[:900]), count, rows_per_bucket=100).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
        assert again.max() < 1.25 * again.mean()
    assert sharding.pack_shards(empty, count).count() == 0


def test_shards_of_a_hot_text_without_ids(spark):
    """A text that half of all rows have, none of them with an id, is dealt out evenly."""
    rows = [(None, "same text " * 15) for _ in range(2000)] + [(i, f"text number {i} " * 10) for i in range(2000)]
    got = sharding.pack_shards(frame(spark, rows), 40).toPandas().groupby("shard")["size"].agg(["sum", "count"])
    assert len(got) == 40 and got["sum"].max() <= 1.05 * got["sum"].mean() and got["sum"].min() >= 0.95 * got["sum"].mean()
    slots = sharding.pack_shards(frame(spark, rows), 40).groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.m + 1 for r in slots)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-300, 300, (400, 16))
    x[50:60] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (None, [1] * 16), (950, [1, 2])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = {}
    for r in topk.topk_inner_products(df, F.col("id") % 50 == 0, 5, rows_per_block=90, queries_per_batch=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    s = x @ x.T
    for q in range(0, 400, 50):
        order = [i for i in np.lexsort((np.arange(400), -s[q])) if i != q][:5]
        assert sorted(got[q]) == [(k + 1, i, s[q, i]) for k, i in enumerate(order)]
    assert set(got) == set(range(0, 400, 50))
    assert topk.topk_inner_products(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_topk_odd_rows(spark):
    rows = [(0, [1, 2], "x", 9), (0, [1, 2], "x", 9), (1, [1, None], "x", 9), (2, [3, 3], "x", 9), (2, [3, 3], "x", 9), (3, [-1, -1], "x", 9), (50, [1, 0, 0], "x", 9), (100, [0, 0], "x", 9)]
    df = spark.createDataFrame(rows, "id long, v array<long>, score string, rank long")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.topk_inner_products(df, F.col("id") % 50 == 0, 3).collect())
    assert got == [(0, 1, 2, 9), (0, 2, 2, 9), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 0, 0), (100, 3, 2, 0)]


def test_bounds_skip_blocks():
    rng = np.random.default_rng(3)
    queries, rows = rng.integers(-50, 50, (4, 8)).astype(float), rng.integers(-50, 50, (60, 8)).astype(float)
    ids = np.arange(60)
    free = topk.sorted_access_topk(queries, np.full(4, -1), rows, ids, 3)
    best = np.array([f[1][-1] for f in free])
    same = topk.sorted_access_topk(queries, np.full(4, -1), rows, ids, 3, best)
    assert all((a[0] == b[0]).all() for a, b in zip(free, same, strict=True))
    assert all(not len(f[0]) for f in topk.sorted_access_topk(queries, np.full(4, -1), rows, ids, 3, np.full(4, 1e9)))


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "<p>one</p>"), (2, "http://b", "x" * 30_000 + "é漢\r\n\r\nWARC/1.1"), (3, "http://c\r\nX: y", "<p>one</p>"), (4, None, None), (5, "u", ""), (None, "n", "solo"), (7, "r", "twice"), (7, "r", "twice")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w", segment_bytes=1000)
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert by[2][0].payload.decode() == pages[1][2] and by[3][0].type == "response" and by[1][0].type == "revisit" and by[1][0].refers_to == by[3][0].record_id
    assert by[5][0].payload == b"" and by[4][0].type == "revisit" and len(by[7]) == 2 and by[None][0].payload == b"solo"
    assert by[1][0].digest == "sha1:" + base64.b32encode(hashlib.sha1(b"<p>one</p>").digest()).decode()
    assert warc.dechunked(warc.chunked(b"abc" * 9000)) == b"abc" * 9000
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab")


def test_archives_are_members_in_files_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Each record can be read from its own gzip member, and a file's size does not follow the number of pages."""
    monkeypatch.setattr(warc, "BUNDLE", 20_000)
    noise = random.Random(5)
    pages = [(i, "u", noise.randbytes(6000).hex(), "clash", 1) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string, salt int").coalesce(1)
    warc.write_archives(df, f"file://{tmp_path}/w", segment_bytes=1000, file_bytes=60_000)
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) > 4 and max(f.stat().st_size for f in files) < 60_000 + 3 * 2_000
    for f in files:
        content, starts = f.read_bytes(), []
        while content:
            unzip = zlib.decompressobj(31)
            starts.append(unzip.decompress(content))
            content = unzip.unused_data
        assert unzip.eof and all(m == b"" or m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in starts)
    got = {r.page_id: r.payload.decode() for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert got == {p[0]: p[2] for p in pages}


def test_archives_of_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 0


def test_missing_segment_is_an_error(spark, tmp_path):
    records = list(warc.page_records(1, "u", b"x" * 5000, 1, None, False, 1000))
    df = spark.createDataFrame([(r.decode(),) for i, r in enumerate(records) if i != 2], "value string").coalesce(1)
    df.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(f"file://{tmp_path}/m")
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_archives(spark, f"file://{tmp_path}/m").collect()


def test_html(spark):
    page = """<html><head><title>no</title><script>var a="<p>no</p>"</script></head><body><header><h1>Site</h1></header><ul id=menu><li><a href=x>Home</a></li></ul><div class="content"><h2>Title  &amp; more</h2>
    <p>First para with many words in it.</p><div class="ad-box">Buy now</div><p>Second<br>para of words.</p><p>End.</p></div><div class=sidebar>side words one two three four</div><section id="comments"><p>Great post I loved it very much</p></section><footer>foot</footer></body></html>"""
    assert html_extract.extract(page) == "Title & more\nFirst para with many words in it.\nSecond para of words.\nEnd."
    rows = [(1, page), (2, None), (3, ""), (4, "just words"), (5, "<p>open <b>bold"), (6, "<script>only"), (7, "<div title='a>b'>quoted"), (8, "<!-- open"), (9, "<a href='" * 2000)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame([(i, "u", h, "clash") for i, h in rows], "page_id long, url string, html string, text string")).collect()}
    assert got[2] == got[3] == got[6] == got[8] == "" and got[4] == "just words" and got[5] == "open bold" and got[7] == "quoted"
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize(("name", "kept"), [
    ("legal-news", True), ("popular-science story", True), ("share-prices", True), ("widget article-body", True), ("content", True), ("advice", True),
    ("ad", False), ("ad-box", False), ("sidebarLeft", False), ("top_banner", False), ("post-comments", False), ("x related-posts", False), ("cookie-notice-2", False), ("main-nav", False),
])
def test_names_in_html(name, kept):
    words = " ".join(f"word{i}" for i in range(40))
    page = f"<body><p>Lead of some words here.</p><div class='{name}'><p>{words}</p></div><div class=x>short</div></body>"
    assert (words in html_extract.extract(page)) == kept


def test_html_repeated_rows(spark):
    rows = [(1, "u", "<article><p>same words here</p></article>")] * 3
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["same words here"] * 3


def test_languages_held_out(spark, data, odd, empty):
    got = langid.op1_langid(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.col("lang").alias("truth")), "doc_id").filter("held_out").toPandas()
    assert (got["lang_pred"] == got["truth"]).mean() > 0.95 and got["score"].between(0, 1).all()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    found = {r.doc_id: r for r in langid.labelled(odd, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3, 9)) and found[4].lang_pred in model["langs"]
    assert langid.labelled(empty, model).count() == 0
    none = langid.fit(empty, F.lit(True))
    assert {r.lang_pred for r in langid.labelled(odd, none).collect()} == {"und"}
    en, de = (docs.filter(F.col("lang") == x).first()["text"][:1500] for x in ("en", "de"))
    spans = langid.labelled(frame(spark, [(1, en + " " + de)]), model).first()["lang_spans"]
    assert {"en", "de"} <= {s["lang"] for s in spans}


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    from itertools import product

    scores, penalty = rng.normal(size=(6, 3)).astype(np.float32), 1.0
    value = lambda p: sum(scores[i, s] for i, s in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))
    best = max(product(range(3), repeat=6), key=value)
    assert tuple(langid.viterbi(scores, np.array([6]), penalty)) == best


def test_quality_held_out(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    got = quality.op7_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = got[got["quality"] == 1]["score"], got[got["quality"] == 0]["score"]
    assert np.mean([(g > b) for g in good for b in bad]) > 0.97
    model = quality.fit(odd, empty.select("doc_id", F.lit(1).alias("quality")), F.lit(True))
    assert {r.score for r in quality.scored(odd, model).collect()} == {0.5}
    assert quality.scored(empty, model).count() == 0
