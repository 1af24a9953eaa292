"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing names, and on empty tables."""

import math
import random
import re
import time
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import jaccard, language, packing, passages, pieces, quality, records, sharding, tokens, topk, url_filter
from lodeworks.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, shared = prose(120), prose(60)
    near = base.split()
    near[60] = "Changed"
    out = [None, "", " \n\t", "one", "one two three", "One two three", "a b c d e", base, base, " ".join(near), base.upper()]
    out += [f"{prose(80)} {shared} {prose(70)}" for _ in range(4)]
    out += [prose(6000), "x" * 50000, "12 34 !!", "é è ñ ß 中文 🙂", "line\nline\nline\n\n", " ".join(["rep"] * 40), f"the of and {prose(40)} #### $$$"]
    out += [prose(rng.randint(1, 60)) for _ in range(40)]
    return out


DOCS = [(i, t, ["en", "fr", None][i % 3], ["a", "a", "b", None][i % 4], i) for i, t in enumerate(texts())]
DOCS += [DOCS[7], DOCS[0]]  # repeated rows


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in DOCS], "doc_id long, text string, lang string, source string, n_chars long, fp string, h int, shard string")
    docs.write.parquet(f"{d}/documents.parquet")
    urls = [None, "", "nothing", "http://A.Example.com/en/1?x#y", "https://www.example.com/en/", "http://x.net/es/", "http://x.net", "ftp://u@h.co.uk:80/p#f", "http://example.com/fr/"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)] + [(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 8], 0) for i in range(120)]
    vectors += [(200, None, 0), (201, [1.0, None, 0.0, 0.0], 0), (250, [float("nan"), 0.0, 0.0, 0.0], 0), (202, [float("inf"), 0.0, 0.0, 0.0], 0), (203, [0.5], 0), (100, vectors[100][1], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def nothing(spark, small, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nothing"))
    for t in ("documents", "pages", "labels", "embeddings"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def test_urls(spark, small):
    got = {r["page_id"]: r for r in url_filter.op1_url_filter(spark, small).collect()}
    assert [got[i]["host"] for i in range(9)] == ["", "", "", "a.example.com", "www.example.com", "x.net", "x.net", "u@h.co.uk:80", "example.com"]
    assert [got[i]["rule"] for i in range(9)] == [None, None, None, "example.com/en/", "www.example.com/en/", "net/es/", None, None, "com/"]
    assert [got[i]["verdict"] for i in (3, 4, 5, 8)] == ["block", "allow", "block", "allow"]
    assert got[3]["path"] == "/en/1" and got[6]["path"] == ""


def test_reputation_shrinks(spark):
    pages = spark.createDataFrame([(i, f"http://bad.shop.org/{i}") for i in range(40)] + [(100 + i, f"http://good{i}.org/") for i in range(60)], "page_id long, url string")
    out = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(60)], "page_id long, bad int")
    got = Counter((r["host"].startswith("bad"), r["verdict"]) for r in url_filter.filter_urls(pages, out).collect())
    assert got == {(True, "block"): 40, (False, "allow"): 60}


def test_language(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.op2_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    edge = {r["doc_id"]: r for r in language.op2_language_id(spark, small).collect()}
    assert edge[0]["lang_pred"] == edge[1]["lang_pred"] == edge[17]["lang_pred"] == "und" and edge[0]["score"] == 0
    assert {edge[i]["lang_pred"] for i in (7, 15, 16)} <= {"en", "fr"} and all(0 <= r["score"] <= 1 for r in edge.values())


def test_codewords():
    for k in (2, 4, 7, 12, 40):
        m = language.codewords(k)
        assert len({tuple(r) for r in m}) == k and np.abs(m.sum(0)).max() < k


def test_long_text_in_blocks(monkeypatch):
    import pyarrow as pa

    col = pa.array(["abc def " * 50, "", "zz", "hello world"])
    count = lambda: {r: sum(int(e - s) for _, rows, ss, es in language._each(col, 14) for q, s, e in zip(rows, ss, es) if q == r) for r in range(4)}
    whole = count()
    monkeypatch.setattr(language, "BLOCK", 37)
    assert count() == whole == {0: 398, 1: 0, 2: 0, 3: 9}


def test_quality(spark, small):
    got = {r["doc_id"]: r for r in quality.op4_quality_rules(spark, small).collect()}
    for i, t, *_ in DOCS:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(w) < 20 or 100 * len(rep) > 30 * len(w)) and not (got[i]["base_failed"] and got[i]["kept"])


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def token_ids(t):
    return [*library().encode(t or "", add_special_tokens=False).ids, 1]


def test_word_encoder(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 500)
    monkeypatch.setattr(tokens, "AT_ONCE", 700)
    rng, e = random.Random(9), tokens.WordEncoder(tokens.default_tokenizer())
    assert e.by_word
    odd = ["don't stop", "ΑΣ ΣΑΣ", "x\x1cy z", "a b", "<|endoftext|> hi", "İ#", "d'́ ", "", "a" * 3000, "I'LL GO!!", "hi <|endoftext|> there", "a<|startoftext|>b <|ENDOFTEXT|>", "'s't ''re'vex.'s 've'", "x'", "'", " \n"]
    odd += ["".join(map(chr, range(256))), "a".join(map(chr, range(256))), "ab cd " * 900]
    odd += ["".join(chr(rng.randrange(256)) for _ in range(60)) for _ in range(200)] + ["".join(chr(rng.choice([rng.randrange(256), rng.randrange(0xD7FF)])) for _ in range(60)) for _ in range(200)]
    odd += ["".join(rng.choice("ab cd\n\t'.,#é 1ΣİǺ\x1d́'sreldmtv") for _ in range(60)) for _ in range(300)]
    assert [list(np.frombuffer(x, "<u4")) + [1] for x in e.ids(odd)] == [token_ids(t) for t in odd]


def test_records(spark, small, tmp_path):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in records.op3_binary_records(spark, small).collect())
    start, want = 0, []
    for i, t, *_ in sorted(DOCS, key=lambda r: (r[0], r[1] or "")):
        ids = token_ids(t)
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_shuffled_read(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    index = records.with_starts(records.write_records(docs, str(tmp_path), file_bytes=4000))
    assert index.select("file").distinct().count() > 8
    mixed = index.repartition(3).sortWithinPartitions(F.xxhash64("start")).cache()
    got = records.read_records(mixed, str(tmp_path), as_given=True, held=2).collect()
    assert [r["start"] for r in got] == [r["start"] for r in mixed.collect()] != sorted(r["start"] for r in got)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((i, np.array(token_ids(t), "<u4").tobytes()) for i, t, *_ in DOCS)


def test_damaged_record():
    import io

    data = records.frame(b"\x00" * 12)
    with pytest.raises(ValueError):
        records.read_record(io.BytesIO(data[:-1] + b"\xff"))
    with pytest.raises(ValueError):
        records.read_record(io.BytesIO(b"\x01" + data[1:]))


def test_packing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = packing.pack(docs, length=256, block=16).collect()
    want = Counter()
    for i, t, *_ in DOCS:
        ids = np.array(token_ids(t), "<u4")
        for k, a in enumerate(range(0, len(ids), 256)):
            want[(i, k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 256
    assert len(bins) <= -(-sum(r["length"] for r in got) // 256) + 2


@pytest.mark.parametrize("kind, length, block", [("null", 4096, 2048), ("third", 64, 16)])
def test_packing_of_tiny_pieces_ends(spark, monkeypatch, kind, length, block):
    """Null, empty and one-word texts, which fill no sequence however many a block has."""
    rounds, whole = [], packing._round

    def counted(*a):
        rounds.append(1)
        assert len(rounds) < 12, "the pool does not shrink"
        return whole(*a)

    monkeypatch.setattr(packing, "_round", counted)
    rows = [(i, None) for i in range(5000)] if kind == "null" else [(i, "" if i % 3 == 0 else "one two" if i % 3 == 1 else "one " * (i % 50)) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), length, block).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    lengths = {t: len(token_ids(t)) for t in {t for _, t in rows}}
    assert sum(r["length"] for r in got) == sum(lengths[t] for _, t in rows)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= length
    assert len(bins) <= -(-sum(r["length"] for r in got) // length) + 2


def test_crossover_keeps_items():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 60)
    a, b = packing.best_fit(sizes, range(60), [], 100), packing.best_fit(sizes, np.argsort(-sizes).tolist(), [], 100)
    c = packing.crossover(sizes, a, b, rng, 100)
    assert sorted(i for g in c for i in g) == list(range(60)) and all(sum(sizes[i] for i in g) <= 100 for g in c)


def test_pieces(spark, small):
    m = pieces.piece_model(pieces.default_model())
    got = {r["doc_id"]: r for r in pieces.op6_sentencepiece(spark, small).collect()}
    assert all(r["round_trip"] for r in got.values())
    for i, t, *_ in DOCS:
        ids = np.array(full_viterbi(m.viterbi, t), "<u4").tobytes()
        assert got[i]["n_pieces"] == len(ids) // 4 and got[i]["ids_crc32"] == zlib.crc32(ids)


def test_encode_and_decode_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumns({"ids": F.lit("x"), "decoded": F.lit("y"), "_k0": F.lit(1)})
    ids = pieces.encode(docs, ["doc_id", "text", "_k0"])
    assert ids.columns == ["doc_id", "text", "_k0", "ids"]
    back = pieces.decode(ids.withColumnRenamed("_k0", "_k1"), ["doc_id", "text", "_k1"]).collect()
    assert len(back) == len(DOCS) and all(r["decoded"] == (r["text"] or "") for r in back)


@pytest.mark.parametrize("c", "=-# x_é")
def test_time_of_runs_is_in_proportion(c):
    m = pieces.PieceModel(pieces.default_model())
    steps = {}
    for n in (2000, 16000):
        start = time.process_time()
        ids = m.encode(c * n + " end")
        steps[n] = time.process_time() - start
        assert m.decode(ids) == c * n + " end" and (n > 2000 or np.frombuffer(ids, "<u4").tolist() == full_viterbi(m.viterbi, c * n + " end"))
    assert steps[16000] < 30 * steps[2000] + 0.2


def full_viterbi(v, text):
    """Ids of the best path over the whole text, with no window and no stretches."""
    if not text:
        return []
    text = "▁" + text.replace("▁", pieces.MARK).replace(" ", "▁")
    best, back = [0.0] + [-math.inf] * len(text), [None] * (len(text) + 1)
    for a in range(len(text)):
        found = [(b, *v.score[text[a:b]]) for b in range(a + 1, min(len(text), a + v.longest) + 1) if text[a:b] in v.score]
        for b, s, i in found if text[a] in v.score else [*found, (a + 1, v.low, None)]:
            if best[a] + s > best[b]:
                best[b], back[b] = best[a] + s, (a, i)
    ids, b = [], len(text)
    while b:
        a, i = back[b]
        ids.append([i] if i is not None else v._fallback(text[a:b]))
        b = a
    return [i for x in reversed(ids) for i in x]


def test_stretches_keep_the_best_path():
    m, rng = pieces.piece_model(pieces.default_model()), random.Random(6)
    odd = ['"yes", he said ("no"). Then, "why?"', "f(a, b[0], c());\n/* x */ y += {'k': 1.5, 'z': []};", "x²; 3.14, 1,000.00: 50% (§7), [a].b;c #1 &c. |d|", "a.b,c;d:e!f?g*h%i$j&k#l|m", "éa, ñ. 中文, 🙂! ,,;; . ,a", "  ..\n,x ()) ));", "▁a", "▁ ▁▁ b▁", "=" * 300 + "a" + "-" * 200]
    odd += ["".join(rng.choice("ab zé1²_ \n\"')]}(/=" + pieces.MARKS) for _ in range(80)) for _ in range(300)]
    names = [p for p in m.viterbi.score if any(c in pieces.MARKS for c in p)]
    odd += ["".join(rng.choice([rng.choice(names).replace("▁", " "), "word", '"', " "]) for _ in range(25)) for _ in range(300)]
    assert m.viterbi.stretch is not None and any("".join(x) in m.viterbi.score for x in ('",', ").", "));"))
    for t in odd:
        assert np.frombuffer(m.encode(t), "<u4").tolist() == full_viterbi(m.viterbi, t) and m.decode(m.encode(t)) == t


def test_streaming_viterbi_is_viterbi():
    rng = random.Random(2)
    rows = [(p, -rng.randint(1, 9) / 1.0, k) for k, p in enumerate({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(40)})]
    v, score = pieces.StreamingViterbi(rows, None, 999), {p: s for p, s, _ in rows}
    v.stretch = None
    for _ in range(60):
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
        full = "▁" + t.replace(" ", "▁")
        best = [0.0] + [-math.inf] * len(full)
        for a in range(len(full)):
            for b in range(a + 1, min(len(full), a + 4) + 1):
                if full[a:b] in score:
                    best[b] = max(best[b], best[a] + score[full[a:b]])
            if full[a] not in score:
                best[a + 1] = max(best[a + 1], best[a] + v.low)
        names = {k: s for _, s, k in rows}
        assert abs(sum(names.get(i, v.low) for i in np.frombuffer(v.encode(t), "<u4").tolist()) - best[-1]) < 1e-9


def test_sharding(spark, small):
    got = sharding.op7_sharding(spark, small, 7).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(DOCS) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in DOCS)
    by = Counter((r["shard"], r["source"]) for r in sharding.shard(spark.read.parquet(f"{small}/documents.parquet"), 7).collect())
    for s in ("a", "b", None):
        each = [by[(k, s)] for k in range(7)]
        assert max(each) - min(each) <= 2


def test_write_shards_keeps_all_rows(spark, tmp_path):
    rows = [(None, "a", "x"), (None, None, None), (1, "b", "x")] + [(2, "same", "y")] * 9 + [(None, "a", "x")] * 3 + [(3, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sharding.write_shards(docs, f"{tmp_path}/shards", 4) == ("shard", "slot")
    got = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(rows)
    for k in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(4))
    docs = docs.withColumns({"row": F.lit("r"), "shard": F.lit("s"), "d": F.lit(1), "size": F.lit(2), "_k0": F.lit(3), "_s": F.lit(4)})
    assert sharding.write_shards(docs, f"{tmp_path}/clash", 4) == ("shard_", "slot")
    got = spark.read.parquet(f"{tmp_path}/clash")
    assert set(got.columns) == {*docs.columns, "shard_", "slot"} and got.select(docs.columns).exceptAll(docs).count() == 0 and got.count() == len(rows)


#: Columns of names that operators may have used inside.
CLASH = "q row base_failed kept ambiguous has lang_pred score th t cut keep rid runs s first_doc _doc _th _t _q fp n block root c i j all k h _k0 _row _s apart".split()


@pytest.mark.parametrize("name", ["quality", "language", "near_duplicates", "repeats"])
def test_filters_keep_clashing_columns(spark, small, name):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumns({x: F.concat(F.lit(f"{x}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for x in CLASH})
    more = spark.createDataFrame([(None, None, None, None, None), (None, DOCS[7][1], "en", "a", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more, allowMissingColumns=True)
    f = getattr(corpus_pipeline, name)
    got = f(spark, docs, small)
    assert got.columns == docs.columns and got.count() > 0
    plain = f(spark, docs.drop(*CLASH), small)
    assert got.drop(*CLASH).exceptAll(plain).isEmpty() and plain.exceptAll(got.drop(*CLASH)).isEmpty()
    assert all(r[x] == f"{x}-{r['doc_id']}" for r in got.where("doc_id IS NOT NULL").collect() for x in CLASH)
    assert f(spark, docs.limit(0), small).isEmpty()


def test_every_language_is_learned(spark):
    rng = random.Random(1)
    alphabet = [chr(0x4E00 + 40 * k) for k in range(300)]
    rows = [(k, f"l{k % 300:03d}", "".join(alphabet[k % 300] if rng.random() < 0.8 else rng.choice("abc") for _ in range(60))) for k in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.identify(docs, language.train(docs), ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and len({r["lang_pred"] for r in got}) > 290


def test_topk(spark, small):
    rows = [(i, r) for i, r in enumerate(spark.read.parquet(f"{small}/embeddings.parquet").collect())]
    ok = [(u, r[0], [math.floor(256 * x) for x in r[1]] + [0] * (4 - len(r[1]))) for u, r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    want = []
    for u, q, x in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for w, i, y in ok if w != u)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.op8_exact_topk(spark, small).collect())) == sorted(want)
    e = spark.createDataFrame([(q, x) for _, q, x in ok], "vec_id long, x array<long>").withColumns({"uid": F.lit("u"), "q": F.lit(1), "score": F.lit("s")})
    assert sorted(map(tuple, topk.top_k(e, 5, F.col("vec_id") % 50 == 0, block=7, chunk_bytes=200).collect())) == sorted(want)


def test_threshold_search_stops_at_the_bound():
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(0, 60, (800, 6)) * rng.pareto(2, (800, 1)))
    uid, lists = np.arange(800), np.argsort(v, axis=0, kind="stable")
    for _ in range(40):
        q, bound = np.floor(rng.normal(0, 60, 6)), rng.choice([topk.NONE, 20000, 200000, 10**9])
        best, score = topk.threshold_search(q, 5, v, uid, uid, lists, 4, bound)
        want = sorted((-s, i) for i, s in enumerate(v @ q) if i != 5 and s >= bound)[:4]
        assert sorted(zip(-score, best)) == want


def brute_classes(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                top[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(i, low.get(find(k), i))
    return sorted((i, len(s), low[find(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("chunk", [jaccard.CHUNK_SETS, 4])
def test_jaccard(spark, small, chunk):
    rng = random.Random(5)
    base = [str(rng.randint(0, 10**6)) for _ in range(90)]
    rows = [(i, t) for i, t, *_ in DOCS]
    for k in range(40):  # a family of near copies, some far from each other
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(90)] = str(rng.randint(0, 10**6))
        rows.append((1000 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs, chunk).collect())
    assert got == brute_classes(rows)


def test_jaccard_of_a_large_block(spark):
    """A long chain of near copies, whose ends are far apart, and a block without a large class, all in chunks of three."""
    rng = random.Random(15)
    w, rows = [str(rng.randint(0, 10**6)) for _ in range(80)], []
    for k in range(60):
        rows.append((2000 - k, " ".join(w)))
        w[rng.randrange(80)] = str(rng.randint(0, 10**6))
    tail = [str(rng.randint(0, 10**6)) for _ in range(40)]
    for k in range(12):
        own = [str(rng.randint(0, 10**6)) for _ in range(rng.choice([8, 30]))]
        rows += [(100 + 2 * k, " ".join(own + tail)), (101 + 2 * k, " ".join(own + tail[:-1] + ["end"]))]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 600).collect())
    assert got == brute_classes(rows) and len({c for _, _, c in got}) < len(rows) / 2


def test_trie_join_random():
    rng = np.random.default_rng(4)
    for _ in range(20):
        pool = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        sets = [np.unique(rng.choice(pool[: rng.integers(10, 60)], rng.integers(5, 40))) for _ in range(40)]
        top = jaccard.trie_join(sets)
        want = list(range(40))
        for a in range(40):
            for b in range(a):
                n = len(np.intersect1d(sets[a], sets[b]))
                if 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
                    x, y = want[a], want[b]
                    want = [min(x, y) if v in (x, y) else v for v in want]
        assert top == want
        label = [k if rng.random() < 0.7 else 100 + k % 3 for k in range(40)]
        for a in range(40):
            for b in range(a):
                if label[a] == label[b]:
                    x, y = want[a], want[b]
                    want = [min(x, y) if v in (x, y) else v for v in want]
        assert jaccard.trie_join(sets, label) == want


def test_near_duplicate_filter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = jaccard.near_duplicate_filter(docs)
    want = [i for i, n, c in brute_classes([(i, t) for i, t, *_ in DOCS]) if n == 0 or i == c]
    want = sorted([i for i in set(want)] + [0])  # the repeated row without text stays, that with text does not
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want


def test_near_duplicate_filter_of_one_id_on_several_texts(spark):
    rng = random.Random(12)
    prose = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(80))
    a, b, c, d = prose(), prose(), prose(), prose()
    near = lambda t: f"{t} more"
    rows = [(3, b), (7, a), (7, near(b)), (7, ""), (7, None), (8, near(a)), (9, c), (9, near(c)), (5, d), (5, d.replace(" ", ", ")), (5, f"{d}  "), (None, near(d))]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, fp int")
    got = jaccard.near_duplicate_filter(docs)
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert got.columns == docs.columns and all((r["doc_id"], r["text"]) == rows[r["fp"]] for r in got.collect())
    assert {(3, b), (7, a), (7, ""), (7, None), (None, near(d))} <= set(kept)
    assert Counter(i for i, _ in kept) == {3: 1, 7: 3, 9: 1, 5: 2, None: 1}  # words with commas are other words
    assert (5, d) in kept


def test_compact_windows_match_sliding_minimum():
    rng = np.random.default_rng(8)
    sh, ends, t = rng.integers(0, 40, 300).astype(np.uint64), np.array([0, 120, 130, 300]), 12
    c, left, right = passages.compact_windows(sh, ends, t, passages.seeds(1)[0])
    keys = [(int(passages.mix(sh[i : i + 1] ^ passages.seeds(1)[0])[0]) >> 26, i) for i in range(300)]
    for a, b in zip([0, 0, 120, 130], ends):
        for i in range(a, b - t + 1):
            least = min(range(i, i + t), key=keys.__getitem__)
            assert [int(x) for x, lo, hi in zip(c, left, right) if lo <= i and i + t - 1 <= hi and i <= x < i + t] == [least]


def test_passages(spark, small):
    found = passages.op10_substring_dedup(spark, small).collect()
    spans = {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    runs = {}
    for i, t, *_ in DOCS:
        w = words(t)
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add((i, k))
    for places in runs.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                assert any(a <= k and k + 50 <= b for a, b in spans[i])
    assert not set(spans) - {7, 8, 9, 10, 11, 12, 13, 14}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = passages.remove_repeats(docs)
    assert left.columns == docs.columns
    assert passages.passages(left.select("doc_id", "text")).count() == 0
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert kept[11] == DOCS[11][1] and kept[15] == DOCS[15][1] and 148 <= len(words(kept[12])) <= 150  # a word beside the passage may be the same by chance


def shingle_set(w):
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def held_by_representative(rows, found):
    """Of each passage that is not a first one, the share of its shingles that the document it names holds."""
    by = {}
    for i, t in rows:
        by.setdefault(i, set()).update(shingle_set(words(t)))
    texts = dict(rows)
    for r in found:
        if not r["is_first"]:
            span = shingle_set(words(texts[r["doc_id"]])[r["start_word"] : r["end_word"]])
            yield len(span & by[r["first_doc"]]) / len(span)


def test_near_passages_are_found(spark):
    """Passages of shingle similarity 0.8 to 0.9, each in two documents; a third has a part of some, and others two in a row."""
    rng = random.Random(21)
    prose = lambda n: [str(rng.randint(0, 10**6)) for _ in range(n)]
    rows, planted = [], []
    for k in range(120):
        base = prose(rng.randint(50, 95))
        near = list(base)
        near[rng.randint(5, len(base) - 6)] = "changed"
        a, b = shingle_set(base), shingle_set(near)
        assert 0.79 < len(a & b) / len(a | b) <= 0.9
        before, after = prose(rng.randint(0, 80)), prose(rng.randint(0, 80))
        rows += [(1000 + k, " ".join(prose(20) + base + prose(40))), (2000 + k, " ".join(before + near + after))]
        planted.append((2000 + k, len(before), len(near)))
        if k % 4 == 0:
            rows.append((100 + k, " ".join(prose(30) + base[:30] + prose(30))))
        if k % 10 == 0:
            rows += [(3000 + k, " ".join(base + after)), (4000 + k, " ".join(prose(60)))]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    hit = [any(a <= at + n // 2 <= b and b - a >= 0.8 * n for a, b in spans.get(i, [])) for i, at, n in planted]
    assert np.mean(hit) >= 0.9
    assert min(held_by_representative(rows, found)) >= 0.8
    assert not {i for i in spans if 4000 <= i or i < 1000}


def test_a_passage_whose_parts_others_have_first(spark):
    rng = random.Random(4)
    prose = lambda n: [str(rng.randint(0, 10**6)) for _ in range(n)]
    a, b, own = prose(30), prose(30), [prose(50) for _ in range(9)]
    rows = [(1, own[0] + a + own[1]), (2, own[2] + b + own[3]), (5, own[4] + a + b), (7, a + b + own[5]), (9, own[6] + a + b + own[7])]
    found = passages.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["first_doc"], r["is_first"]) for r in found) == [(5, 50, 110, 5, True), (7, 0, 60, 5, False), (9, 50, 110, 5, False)]


def test_representatives_hold_their_passages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = list(held_by_representative([tuple(r) for r in docs.collect()], passages.passages(docs).collect()))
    assert len(held) > 20 and min(held) >= 0.8


def test_pipeline(spark):
    import corpus_pipeline

    sf, docs = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = f(spark, docs, sf)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == docs.count()
