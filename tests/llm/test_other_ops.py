"""WARC, HTML, vector operators, passages and the pipeline against brute force, with odd rows."""

import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_warc_round_trip(spark):
    from termloom.llm.warc import archive_folder, read_archives, train_dictionary, with_owners, write_archives

    long, other = "<p>" + "x" * 1200, "<p>é" + "y" * 1200
    rows = [(1, "http://a/1", long), (2, None, long), (9, "http://a/ b\r\nX: y", long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", other), (None, "u", other), (None, "u", "n" * 2000), (8, "u", "a\r\n\r\nb" * 300), (9, "u", long)]
    pages = spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, n int, digest string")
    archives = write_archives(with_owners(pages, "page_id", "html"), archive_folder(spark), train_dictionary(pages, "html"), archive_bytes=3000)
    assert archives.count() > 1
    got = read_archives(archives).collect()
    owner = {}
    for k, _, h in rows:
        if k is not None and len((h or "").encode()) >= 1000:
            owner[h] = max(owner.get(h, k), k)
    want = []
    for k, _, h in rows:
        b = (h or "").encode()
        ref = owner[h] if h in owner and owner[h] != k else None
        want.append((k, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref, None if ref is not None else bytes(b)))
    assert sorted(map(repr, want)) == sorted(repr((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload)) for r in got)
    none = write_archives(with_owners(pages.limit(0), "page_id", "html"), archive_folder(spark), train_dictionary(pages.limit(0), "html"))
    assert read_archives(none).count() == 0


def test_warc_reader_uses_the_dictionary_frame_and_finds_faults():
    import struct

    import zstandard

    from termloom.llm.warc import DICTIONARY_MAGIC, parse, payload_of, record, records

    texts = [(f"<html>{i} common words of every page {i % 7}</html>" * 20).encode() for i in range(300)]
    words = zstandard.train_dictionary(2000, texts).as_bytes()
    raws = [record(i, "u", t, hashlib.sha1(t).hexdigest(), None, "2020-01-01T00:00:00Z") for i, t in enumerate(texts)]
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    body = b"".join(c.compress(r) for r in raws)
    for held in (words, zstandard.ZstdCompressor().compress(words)):
        archive = struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held + body
        assert list(records(io.BytesIO(archive).read)) == raws
    assert [payload_of(*parse(r))[2] for r in raws] == texts
    assert list(records(io.BytesIO(b"").read)) == []
    for broken in (archive[:-3], archive + b"junk" * 8):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(records(io.BytesIO(broken).read))
    for raw in (raws[0].replace(b"WARC/1.1", b"WARC/9.9"), raws[0].replace(b"common", b"commen", 1), raws[0][:-1], raws[0].replace(b"WARC-Date", b"WARC-Dat")):
        with pytest.raises(ValueError):
            parse(raw)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body><header><p>Site name here</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site.</p><button>OK</button></div><div class=ad>Buy this thing now.</div>
<article><h1>A headline of the piece</h1><p>First  paragraph &amp; more\n text, with <b>bold</b> words and 3 &lt; 4.<p>Second paragraph without an end tag, and a line<br>broken in two.
<ul><li>One item of the list<li>Another item</ul><!-- <p>no</p> --><blockquote><p>A quoted sentence, said twice.</p></blockquote></article>
<aside><h3>Related</h3><p>Other story</p></aside><form><label>Search</label><input></form>
<section class="comments"><h3>Comments</h3><div class="comment"><b>joe</b><p>I liked this, a long comment on it all.</p></div></section><footer>&copy; 2020 Site</footer></body></html>"""


def test_quotes_count_only_behind_an_equals_sign():
    from termloom.llm.htmlcrf import leaf_blocks

    page = "<article><p data-x=it's>one two</p><p title='a > b' id=\"q\">three</p><p 'odd>four</p><p a = 'x>y'>five</p><p a=>six</p></article>"
    assert [b.text for b in leaf_blocks(page)] == ["one two", "three", "four", "five", "six"]


def test_many_open_tags_close_in_linear_time():
    import time

    from termloom.llm.htmlcrf import leaf_blocks

    start = time.time()
    assert [b.text for b in leaf_blocks("<div>" * 50_000 + "<p>deep</p>" + "</span></div>" * 50_000 + "<p>end</p>")] == ["deep", "end"]
    assert [b.text for b in leaf_blocks("<b>" * 50_000 + "x" + "</i><li>" * 20_000 + "y")] == ["x", "y"]
    assert time.time() - start < 20


def test_html_main_text(spark):
    from termloom.llm.htmlcrf import extract

    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav><a>Home</a></nav>"), (1, "u", PAGE), (5, "u", "<p>" * 3000 + "deep"), (6, "u", "a < b <"), (7, "u", "<article><p>" + "long words here. " * 60_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = extract(pages, "html", ["page_id", "url"]).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "\n\n".join(["A headline of the piece", "First paragraph & more text, with bold words and 3 < 4.", "Second paragraph without an end tag, and a line broken in two.", "One item of the list", "Another item", "A quoted sentence, said twice."])
    assert by[2] == by[3] == by[4] == "" and len(by[7]) > 900_000
    assert extract(pages.limit(0), "html", ["page_id"]).count() == 0


def test_html_field_holds_out():
    from termloom.llm.htmlcrf import default_field, labelled_columns, labelled_pages

    right = n = 0
    for columns, labels in labelled_columns(labelled_pages(seed=99, n=60)):
        out = default_field().decode(columns)
        right += sum(a == b for a, b in zip(out, labels, strict=True))
        n += len(labels)
    assert right / n > 0.95


def test_viterbi_finds_the_best_path():
    from itertools import product

    from termloom.llm.htmlcrf import COLUMNS, Field

    rng = np.random.default_rng(5)
    field = Field(rng.normal(size=(COLUMNS, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    page = [[int(c) for c in rng.integers(0, COLUMNS, 3)] for _ in range(7)]
    e = field.potentials(page)

    def value(path):
        return field.start[path[0]] + sum(e[i, s] for i, s in enumerate(path)) + sum(field.pair[a, b] for a, b in zip(path, path[1:], strict=False))

    assert field.decode(page) == list(max(product((0, 1), repeat=7), key=value)) and field.decode([]) == []


def odd_vectors(spark, n=600, d=16):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d))
    x[100:140] = x[100]  # copies
    for i in range(200, 260):
        x[i] = x[200] + 0.05 * rng.normal(size=d)  # near copies
    rows = [(i, [float(np.float32(v)) for v in r], int(i % 3) if not 100 <= i < 260 else 1) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * d, 1), (902, [float("nan")] * d, 1), (903, [None] * d, 1), (904, [float("inf")] + [0.0] * (d - 1), 1), (None, rows[0][1], 0), (905, rows[0][1], None), (906, [1.0], 1), (907, [], 1), (0, rows[0][1], 0)]
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, label int, node string, score double")


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("chunk", [16_384, 50])
def test_voronoi_top_k(spark, chunk):
    from termloom.llm.voronoi import quantised, top_k

    df = odd_vectors(spark)
    rows = [r for r in df.collect() if r.vec_id is not None and sound(r.embedding) and len(r.embedding) == 16]
    ids = {r.vec_id: np.floor(1024 * np.array(r.embedding, float)).astype(int) for r in rows}
    got = top_k(df.select("vec_id", quantised("embedding").alias("whole"), "node"), "vec_id", "whole", 10, chunk_rows=chunk, group_queries=2, pivots=8).collect()
    want = []
    for q in (i for i in ids if i % 100 == 0):
        best = sorted((-int(ids[q] @ v), i) for i, v in ids.items() if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(df.limit(0).select("vec_id", quantised("embedding").alias("whole")), "vec_id", "whole").count() == 0
    few = df.where("vec_id in (100, 200, 300)").select("vec_id", quantised("embedding").alias("whole"))
    assert top_k(few, "vec_id", "whole").count() == 6


@pytest.mark.parametrize("most", [4096, 8])
def test_cross_polytope_links(spark, most):
    from termloom.llm.crosspolytope import near_vectors

    df = odd_vectors(spark)
    rows = df.collect()
    got = near_vectors(df, most=most).collect()
    assert len(got) == len(rows)
    ok = [r for r in rows if sound(r.embedding) and any(r.embedding) and r.label is not None]
    links = found = 0
    by = {}
    for r in got:
        by.setdefault(r.vec_id, r)
    for r in ok:
        v = np.array(r.embedding, float)
        n = sum(1 for o in ok if o is not r and o.label == r.label and len(o.embedding) == len(v) and v @ np.array(o.embedding, float) / np.linalg.norm(v) / np.linalg.norm(np.array(o.embedding, float)) >= 0.93)
        links += n
        assert by[r.vec_id].n_links <= n
        found += by[r.vec_id].n_links
    assert found >= 0.97 * links
    for i in (900, 901, 902, 903, 904, 905, 906, 907):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert {by[i].component_id for i in range(100, 140)} == {100} and {by[i].component_id for i in range(200, 260)} == {200}
    assert by[None].component_id == 0 and by[None].n_links == 2
    assert near_vectors(df.limit(0)).count() == 0


def test_cross_polytope_recall_on_random_pairs():
    from termloom.llm.crosspolytope import probes

    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)  # cosine 0.93 exactly
    a, b = probes(x), probes(y)
    meet = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    assert meet.mean() >= 0.97


def test_fenwick_chains_are_optimal():
    from termloom.llm.passages import GAP_COST, K, chains

    rng = np.random.default_rng(6)
    for _ in range(30):
        pts = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 14), rng.integers(0, 60, 14), strict=True)})
        x, y = np.array(pts).T
        best = chains(x, y)[0]
        value = lambda p: sum(n for _, _, n in p) - GAP_COST * sum(c[0] + c[1] - a[0] - a[1] - 2 * a[2] for a, c in zip(p, p[1:], strict=False))
        segs = sorted(s for c in chains(x, y) for s in c)
        f = {}
        for s in segs:
            f[s] = s[2] + max([0.0, *(f[r] - GAP_COST * (s[0] + s[1] - r[0] - r[1] - 2 * r[2]) for r in segs if r in f and r[0] + r[2] <= s[0] and r[1] + r[2] <= s[1])])
        assert value(best) == pytest.approx(max(f.values())) and K == 5


def test_repeated_passages(spark):
    from termloom.llm.passages import repeated_passages

    rng = np.random.default_rng(9)
    text = lambda n: [f"w{int(i)}" for i in rng.integers(0, 50_000, n)]
    shared, license_ = text(70), text(30)
    fuzzy = [w if i % 14 else "edit" for i, w in enumerate(shared)]
    docs = {i: text(200) for i in range(30)}
    docs[1][50:50], docs[2][120:120], docs[3][0:0] = shared, shared, fuzzy
    for i in range(10, 30):
        docs[i][20:20] = license_  # too short to be a passage
    docs[40] = docs[5]
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(50, None), (51, ""), (None, " ".join(docs[1])), (52, "few words"), (1, " ".join(docs[1]))]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, pos int, other string")
    got = repeated_passages(df).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 5, 40}
    by = {r.doc_id: r for r in got}
    assert (by[2].start_word, by[2].end_word, by[2].other_id, by[2].other_start) == (120, 190, 1, 50)
    assert by[3].n_words >= 60 and by[3].similarity >= 0.8 and by[40].n_words == 200 and by[40].other_id == 5
    assert repeated_passages(df.limit(0)).count() == 0


def test_many_documents_share_one_passage(spark):
    from termloom.llm.passages import repeated_passages

    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(30)) + " " + shared) for i in range(400)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(400)) and len(got) == 400


def small_folder(spark, tmp_path):
    rng = np.random.default_rng(12)
    good = lambda: " ".join(f"calm{int(i)}" for i in rng.integers(0, 400, 80)) + "."
    rows = [(i, good() if i % 4 else " ".join(f"X{int(j)}&&!!" for j in rng.integers(0, 9, 60)), "en", "ab"[i % 2], 10) for i in range(240)]
    rows += [(300, rows[1][1], "en", "a", 10), (301, good() + ' token = "abcdefabcdef12345678"', "en", None, 10), (302, None, "en", "a", 0), (None, good(), None, "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rows = small_folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == cp.COLUMNS, name
        path = f"{tmp_path}/{name.split()[0]}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        ids = {r.doc_id for r in docs.collect()}
        if name.startswith("quality"):
            assert ids >= {i for i in range(240) if i % 4} | {300, 301, None} and not ids & {i for i in range(240) if i % 4 == 0}
        if name.startswith("SimHash"):
            assert 300 not in ids and 1 in ids
        if name.startswith("secret"):
            hidden = docs.where("doc_id = 301").first()
            assert "abcdefabcdef" not in hidden.text and "<assign>" in hidden.text and hidden.n_chars == len(hidden.text)
    last = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == docs.count() and {r.doc_id for r in last} == {r.doc_id for r in docs.collect()} and rows
    texts = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert all(r.decoded_sha256 == texts[r.doc_id] for r in last)


def test_pipeline_run_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    small_folder(spark, tmp_path)
    assert cp.run(spark, str(tmp_path)).where(F.col("n_tokens") > 0).count() > 100
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
