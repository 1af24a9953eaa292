"""Toxicity, conversation repair and cross-tokenizer alignment against brute force and on edge cases."""

import hashlib
import random
import re
import zlib

import pytest

from lodeworks.llm import repair

SHA0 = hashlib.sha256(b"").hexdigest()


# conversation repair: every rule again, in plain Python


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        some = lambda x: " " if x is None else x
        k = zlib.crc32(f"{some(c)}:{some(t)}".encode()) % 20
        role, text = some(role), some(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """rows of one conversation (turn, role, text) -> gaps .. audit, sha."""
    said = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], said(r)))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "c")
        seen.add((role, text))
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    step = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    nxt = "uuau"
    n = len(rows)
    best = [[None] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for q in range(4):
            opts = [(0, "")] if i == n and q in (0, 3) else []
            if i < n:
                opts.append((3 + best[i + 1][q][0], "D" + best[i + 1][q][1]))
                if faults[i] in "ct":
                    more, r = int(faults[i] == "t"), rows[i][1][:1]
                    if r in step[q]:
                        x = best[i + 1][step[q][r]]
                        opts.append((more + x[0], "K" + x[1]))
                    x = best[i + 1][step[q][nxt[q]]]
                    opts.append((2 + more + x[0], "R" + x[1]))
            best[i][q] = min(opts, default=(1 << 40, ""))
        for _ in range(3):
            for q in range(4):
                x = best[i][step[q][nxt[q]]]
                best[i][q] = min(best[i][q], (2 + x[0], "I" + x[1]))
    cost, audit = best[0][0]
    lines, i, q = [], 0, 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        r = rows[i][1][:1] if e == "K" else nxt[q]
        lines.append(f"{rows[i][1]}:{rows[i][2]}" if e == "K" else f"{repair.NAMES[r]}:{rows[i][2] if e == 'R' else ''}")
        q = step[q][r]
        i += e != "I"
    count = faults.count
    return gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_rows(rng, convs, longest):
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", None, "tool", ""])
            text = rng.choice(["Yes.", "No", "x y", " ", None, "", "é!", f"{rng.random()}."])
            rows.append((c, rng.choice([t, t, t, t + 1, None]), role, text))
    return rows


def test_search_is_least(monkeypatch):
    """Edits of random conversations, in segments of any length, are the cheapest and least."""
    rng = random.Random(5)
    for k in range(300):
        rows = [(t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", f"{t}.", f"{t}"])) for t in range(rng.randint(1, 30))]
        want = plain_repair(rows)
        seen, letters = set(), ""
        rows = sorted(rows, key=lambda r: r[0])
        for _, role, text in rows:
            f = "b" if not text else "d" if (role, text) in seen else "t" if text[-1] != "." else "c"
            seen.add((role, text))
            letters += repair.letter(role[0] if role[0] in "sua" else "x", f)
        monkeypatch.setattr(repair, "SEGMENT", rng.choice([1, 2, 3, 7, 16]))
        cost, edits, _ = repair.solve(letters, repair.END, True, (0,))[0]
        assert (cost, edits) == (want[5], want[6])


@pytest.mark.parametrize("chunk", [3, 4096])
def test_repair_matches_plain_python(spark, tmp_path, monkeypatch, chunk):
    """Whole query: nulls in any column, empty texts, ties, repeated rows, clashing columns, conversations cut into chunks."""
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = random_rows(rng, [None, *range(40)], 12) + random_rows(rng, [77], 300) + [(5, 1, "user", "Hi.")] * 50 + [(6, 2, "user", "long " * 50000)]
    data = [(*r, 1, "x") for r in rows]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string, cost int, key string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: [r[k] for k in NAMES] for r in repair.op12_conversation_repair(spark, str(tmp_path)).collect()}
    left = {}
    for c, t, role, text in plain_damage(rows):
        left.setdefault(c, []).append((t, role, text))
    want = {c: list(plain_repair(left[c])) if c in left else [0] * 6 + ["", SHA0] for c in {r[0] for r in rows}}
    assert got == want


def test_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op12_conversation_repair(spark, str(tmp_path)).collect() == []


# cross-tokenizer alignment


def plain_alignment(docs):
    """Every rule again, token by token."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    chars = sorted(pre_tokenizers.ByteLevel.alphabet())
    own = [c for c in chars if ord(c) < 256]
    code = {c: ord(c) for c in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if chr(x) not in own)}
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    links, shapes, count = [], [], {}
    for _, text in docs:
        raw = b" " + (text or "").encode()
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ba, bb = [bytes(code[c] for c in a.id_to_token(i)) for i in ia], [piece(b.id_to_piece(i)) for i in ib]
        if not text or b"".join(ba) != raw or b"".join(bb) != raw:
            links.append([])
            shapes.append((0, 0, 0, ""))
            continue
        ranges = lambda xs: [(sum(map(len, xs[:k])), sum(map(len, xs[: k + 1]))) for k in range(len(xs))]
        ra, rb = ranges(ba), ranges(bb)
        found, j = [], 0
        for x, (lo, hi) in zip(ia, ra):
            found += [(x, y) for y, (l2, h2) in zip(ib, rb) if l2 < hi and lo < h2]
        links.append(found)
        for p in found:
            count[p] = count.get(p, 0) + 1
        cuts = sorted({h for _, h in ra} & {h for _, h in rb})
        groups = [",".join(str(x) for x, (_, h) in zip(ia, ra) if lo < h <= hi) + "|" + ",".join(str(y) for y, (_, h) in zip(ib, rb) if lo < h <= hi) for lo, hi in zip([0, *cuts], cuts)]
        shapes.append((len(ia), len(ib), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return sorted(
        ((d, *s[:3], len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls), s[3]) for (d, _), s, ls in zip(docs, shapes, links)), key=str
    )


ODD = [
    None, "", " ", "  two  spaces\n\n\ttabs ", "a▁b", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café – “quotes” €", "漢字かな交じり文 и кириллица", "🙂👍🏽 emoji", "x" * 900, " " * 700 + "end",
    "It's we'll they've I'd 'S 1234567 ³²¼ \x00\x01\x1c\x85\xa0", "﻿bom ́ combining", "def f(x):\n    return x**2  # code", "word " * 3000, "same text here", "same text here",
]


@pytest.mark.parametrize("block", [40, 4 << 20])
def test_alignment_matches_plain_python(spark, tmp_path, monkeypatch, block):
    from lodeworks.llm import alignment

    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = random.Random(3)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()
    docs = [(r["doc_id"], r["text"][:600]) for r in rows] + [(1000 + i, x) for i, x in enumerate(ODD)] + [(1000, "a repeated id"), (None, "no id")]
    docs += [(2000 + i, "".join(chr(rng.choice([rng.randrange(1, 256), rng.randrange(32, 127), 32]))for _ in range(80))) for i in range(60)]
    data = [(d, x, 1) for d, x in docs]
    spark.createDataFrame(data, "doc_id long, text string, n_a int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op13_tokenizer_alignment(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_alignment(docs)


def test_fast_encoder_has_the_library_ids():
    """Ids of the fast encoder against the library, on texts of all kinds."""
    from lodeworks.llm import alignment

    t, rng = alignment.tokens(alignment._path("byte_bpe_50k.json"), alignment._path("piece_bpe_32k.model")), random.Random(7)
    texts = [x for x in ODD if x] + ["".join(chr(rng.randrange(256)) for _ in range(rng.randrange(1, 300))) for _ in range(400)]
    texts += ["".join(rng.choice("ab 'sSt.,!1²\n\t\x85\xa0\x1céß") for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    assert t.fast and t.encode_a(texts) == [e.ids for e in t.a.encode_batch(texts, add_special_tokens=False)]


def test_alignment_of_nothing(spark, tmp_path):
    from lodeworks.llm import alignment

    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert alignment.op13_tokenizer_alignment(spark, str(tmp_path)).collect() == []


# toxicity


def test_codes_cover_texts_in_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lodeworks.llm import toxicity

    rng = random.Random(1)
    for text in ["", "a", "Idiot!", "".join(rng.choice("aB é.1") for _ in range(500))]:
        data = " " + "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 else " " for c in text) + " "
        raw = data.encode()
        want = sorted(k << 56 | int.from_bytes(raw[i : i + n], "big") for k, n in enumerate(toxicity.SIZES) for i in range(len(raw) - n + 1))
        for block in (1, 7, 64, 1 << 20):
            monkeypatch.setattr(toxicity, "BLOCK", block)
            got = list(toxicity.text_blocks(pa.scalar(text, pa.large_string()).cast(pa.large_binary())))
            assert sorted(np.concatenate(got).tolist()) == want


def test_toxicity_scores_are_the_formula(spark):
    """Counts, log-count ratios, choice of features and scores again in plain Python."""
    import math

    import numpy as np

    from lodeworks.llm import toxicity

    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "cat", "sat", "Idiot" if i % 3 == 0 else "mat", "on"]) for _ in range(rng.randrange(1, 30)))) for i in range(90)]
    labels = [(i, int(i % 3 == 0), 7) for i in range(80)]
    s = toxicity.Settings(features=40)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    model = toxicity.train(d, lab, s)

    def grams(t):
        raw = (" " + re.sub("[^a-z]", " ", t.lower()) + " ").encode()
        return [k << 56 | int.from_bytes(raw[i : i + n], "big") for k, n in enumerate(toxicity.SIZES) for i in range(len(raw) - n + 1)]

    p, q = {}, {}
    for i, t in docs[:80]:
        for g in set(grams(t)):
            (p if i % 3 == 0 else q)[g] = (p if i % 3 == 0 else q).get(g, 0) + 1
    every = sorted(set(p) | set(q))
    n1, n0 = 27, 53
    term = lambda a, n: (a * math.log(a / n) if a else 0) + ((n - a) * math.log((n - a) / n) if a < n else 0)
    gain = {g: round(term(p.get(g, 0), n1) + term(q.get(g, 0), n0) - term(p.get(g, 0) + q.get(g, 0), 80), 6) for g in every}
    best = sorted(sorted(every, key=lambda g: (-gain[g], g))[:40])
    assert model["names"].tolist() == best
    sp, sq = sum(p.values()) + len(every), sum(q.values()) + len(every)
    r = np.array([math.log((p.get(g, 0) + 1) / sp) - math.log((q.get(g, 0) + 1) / sq) for g in best])
    x = np.array([[r[k] * math.log1p(grams(t).count(g)) for k, g in enumerate(best)] for _, t in docs])
    y = np.array([int(i % 3 == 0) for i in range(80)])
    w = toxicity.fit(x[:80], y, s)
    want = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    got = {row["doc_id"]: row["score"] for row in toxicity.score(d, model, ["doc_id"]).collect()}
    assert np.allclose([got[i] for i in range(90)], want, atol=1e-6)
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i, t in docs if "Idiot" in t or i % 3)


def test_toxicity_held_out(spark):
    from lodeworks.llm import toxicity

    sf = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op11_toxicity(spark, sf).join(marks, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.98
    assert not any(r["predicted"] for r in got if r["toxic"] == 0)
    assert sum(r["predicted"] for r in got) / sum(r["toxic"] for r in got) > 0.9


def test_toxicity_edge_rows(spark, tmp_path):
    """Null and empty texts, null and repeated labels, equal rows, clashing columns, a very long text, empty tables."""
    from lodeworks.llm import toxicity

    docs = [(i, "you idiot" if i % 2 else "good day", 0.5) for i in range(40)] + [(50, None, 0.5), (51, "", 0.5), (None, "you idiot", 0.5), (1, "you idiot", 0.5), (60, "good day " * 200000 + "you idiot", 0.5)]
    labels = [(i, i % 2) for i in range(40)] + [(3, 0), (4, None), (None, 1), (50, 0)]
    for name, rows, label in (("a", docs, labels), ("b", docs, []), ("c", [], labels), ("d", docs, [(i, 1) for i in range(9)])):
        spark.createDataFrame(rows, "doc_id long, text string, score double").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(label, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = toxicity.op11_toxicity(spark, f"{tmp_path}/a").collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 40)
    assert len({r["score"] for r in got if r["doc_id"] in (50, 51)}) == 1
    assert {r["score"] for r in toxicity.op11_toxicity(spark, f"{tmp_path}/b").collect()} == {0.0}
    assert toxicity.op11_toxicity(spark, f"{tmp_path}/c").collect() == []
    assert {r["score"] for r in toxicity.op11_toxicity(spark, f"{tmp_path}/d").collect()} == {1.0}


# packing


def test_genetic_search_beats_best_fit():
    """Instances of known optimum that best fit misses and the genetic search meets."""
    import numpy as np

    from lodeworks.llm import packing

    for sizes, best in (([32, 47, 21, 68, 18, 14, 62, 5, 33, 39, 27, 34], 4), ([76, 6, 18, 43, 16, 41, 24, 1, 75, 37, 45, 18], 4)):
        sizes = np.array(sizes)
        order = np.argsort(-sizes, kind="stable").tolist()
        assert len(packing.best_fit(sizes, order, [], 100)) == best + 1
        got = packing.evolve(sizes, 3, [], 100)
        assert len(got) == best and sorted(i for b in got for i in b) == list(range(len(sizes))) and all(sum(sizes[b]) <= 100 for b in got)


def test_evolved_packings_against_every_packing():
    """Of small instances: never under the optimum of an exhaustive search, and at it in nearly all."""
    import numpy as np

    from lodeworks.llm import packing

    def least(sizes, length):
        best = [len(sizes)]

        def put(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= length and bins[k] not in bins[:k]:
                    put(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
            put(i + 1, [*bins, sizes[i]])

        put(0, [])
        return best[0]

    rng, met = random.Random(4), 0
    for k in range(60):
        sizes = sorted((rng.randrange(5, 70) for _ in range(rng.randrange(1, 12))), reverse=True)
        got, best = len(packing.evolve(np.array(sizes), k, [], 100)), least(sizes, 100)
        assert got >= best
        met += got == best
    assert met >= 58


@pytest.mark.parametrize("parts", [1, 4])
def test_packing_does_not_depend_on_the_order_of_rows(spark, parts):
    """Long and short documents in turn, which pair up only if every block has both."""
    from lodeworks.llm import packing

    docs = spark.createDataFrame([(i, "one " * (2500 if i % 2 else 1500)) for i in range(2048)], "doc_id long, text string")
    got = packing.pack(docs.coalesce(1) if parts == 1 else docs.repartition(parts), block=256)
    assert got.select("sequence_id").distinct().count() <= 1028
    same = packing.pack(spark.createDataFrame([(i, "x " * 2500) for i in range(1000)], "doc_id long, text string"), block=256)
    assert same.select("sequence_id").distinct().count() == 1000


# exact top-k


def test_topk_with_huge_components(spark, tmp_path):
    """Vectors with a finite component beyond the range of scores take no part; those at its edge are exact."""
    import math

    from lodeworks.llm import topk

    edge = float(math.isqrt((1 << 62) // 3) // 256)
    vectors = [(0, [1.0, 2.0, 3.0]), (1, [1e30, 0.0, 0.0]), (2, [0.0, -1e30, 0.0]), (3, [edge, edge, edge]), (4, [-edge, -edge, -edge]), (50, [edge, -edge, edge]), (100, [1e300, 1.0, 1.0]), (5, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    held = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i in (0, 3, 4, 50)}
    want = []
    for q in (0, 50):
        scores = sorted((-sum(a * b for a, b in zip(held[q], v)), i) for i, v in held.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, topk.op8_exact_topk(spark, str(tmp_path)).collect())) == sorted(want)


def test_url_filter_leaves_one_table(spark, tmp_path):
    import os

    from lodeworks.llm import common, url_filter

    def left():
        at = common.shared_dir(spark).removeprefix("file:")
        return sorted(os.listdir(f"{at}/lodeworks/kept")) if os.path.isdir(f"{at}/lodeworks/kept") else []

    before = left()
    url_filter.op1_url_filter(spark, "/root/testdata/sf0.001").collect()
    new = set(left()) - set(before)
    assert len(new) == 1 and next(iter(new)).startswith("reputation")


# language ID: decoding again in plain Python


def test_language_decoding_in_plain_python(spark):
    import math

    from lodeworks.llm import language

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs.where(~language.held_out()))
    rows = [r for r in docs.select("doc_id", "text").collect() if r["text"]][:80]
    log2, k, n_langs = language.Settings().buckets_log2, model["weights"].shape[1], len(model["langs"])
    got = {r["doc_id"]: r for r in language.identify(docs.select("doc_id", "text"), model, ["doc_id"]).collect()}
    for row in rows:
        raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in row["text"].encode())
        grams = [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % (1 << 32)) >> (32 - log2) for i in range(len(raw) - 2)]
        sums = [math.fsum(float(model["weights"][g, j]) for g in grams) for j in range(k)]
        z = [2 * sums[j] / max(len(grams), 1) / model["scale"][j] for j in range(k)]
        loss = [sum(math.log1p(math.exp(-z[j] * model["code"][c][j])) * model["trust"][j] for j in range(k)) for c in range(n_langs)]
        low = min(loss)
        assert got[row["doc_id"]]["lang_pred"] == model["langs"][loss.index(low)]
        assert abs(got[row["doc_id"]]["score"] - 1 / sum(math.exp(-4 * (x - low)) for x in loss)) < 1e-3


# the pipeline, whole


def test_pipeline_on_empty_and_edge_tables(spark, tmp_path):
    """Null, empty, very long and repeated rows, and columns with the names that stages use inside, through all stages."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, b long, place long"
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    data = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows]
    longest = " ".join(f"{w}{i}" for i, w in enumerate((rows[0]["text"] + " ").split() * 400))
    data += [(9001, None, None, None), (9002, "", "en", "s"), (9003, "1 2 3", None, "s"), (9004, longest, "en", "s"), (9004, longest, "en", "s"), (None, rows[1]["text"] + " and a tail of its own", "en", "s")]
    data += [(r["doc_id"] + 20000, r["text"], r["lang"], r["source"]) for r in rows[:50]]
    spark.createDataFrame([(*r, 7, "x", 1, 2) for r in data], kind).repartition(4).write.parquet(f"{tmp_path}/edge/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/edge").collect()
    ids = {r["doc_id"] for r in got}
    assert ids and not ids & {9001, 9002, 9003} and not {i for i in ids if i and i > 20000}  # of copies the first stays
    assert sum(r["piece"] == 0 for r in got if r["doc_id"] == 9004) <= 1
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096
