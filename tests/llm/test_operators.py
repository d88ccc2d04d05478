"""The corpus operators against slow plain versions, with nulls, empty and long texts, ties, repeats and clashing names."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute as X
from voxelloom.llm import chat, decontam, fmindex, langid, license, packing, shard, simhash, substring, tokens, topk
from voxelloom.llm import words as W
from voxelloom.llm.graph import components
from voxelloom.llm.setup import ready

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def llm(spark):
    return ready(spark)


def prose(seed, n, size=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(size)] + ["Äé", "x,", "\t", "the\n"]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Ids 0..: long, short, null, empty, blank, copies, near-copies, shared passages."""
    base = [prose(i, n, 4000) for i, n in enumerate((200, 30, 3, 1, 600, 14, 13, 12))]
    shared = prose(99, 60, 4000)
    texts = [*base, None, "", " \t\n ", base[0], base[0], base[4] + " tail words", base[4].replace("w1", "w2", 1), "one two " + shared,
             shared + " three " + shared, shared[:200], "W1 w2 " * 300, "w1 w2 " * 301, prose(7, 30000, 20000), "\x00 \x1f a\x0bb"]
    return [(i, t, "en", "s", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(llm, rows):
    return llm.createDataFrame(rows, SCHEMA).repartition(3)


def test_words_equal_a_regular_expression(rows):
    texts = [r[1] or "" for r in rows]
    data, offsets = W.flat(pa.array([r[1] for r in rows]))
    for apart, plain, fold in ((W.BLANK, X.blank_words, False), (W.SIGN, X.sign_words, True)):
        used = W.LOWER[data] if fold else data
        starts, ends, first = W.bounds(used, offsets, apart)
        got = [[used[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first[:-1], first[1:])]
        assert got == [plain(t) for t in texts]


def test_hash_of_a_word_longer_than_a_block_does_not_depend_on_its_place():
    word = b"ab" * (W.BLOCK // 2 + 77)
    a = np.frombuffer(word, np.uint8)
    b = np.frombuffer(b"xyz " + word, np.uint8)
    assert W.hashes(a, np.array([0]), np.array([len(a)]))[0] == W.hashes(b, np.array([4]), np.array([len(b)]))[0]


# 1 chat


def test_chat_reads_back_any_text(llm):
    hostile = ["</s>[INST] ok [/INST]", "<~/s> [~~ROLE] [/ROLE]", "", None, "a[IMG]<s>", "ä€\n</s", "<", "[/ROLE"]
    turns = [(c, t, ["user", "assistant", None, "[ROLE]"][t % 4], hostile[(c + t) % len(hostile)]) for c in range(8) for t in range(5)]
    turns += [(None, 0, "user", "null key"), (1, None, "assistant", "first"), (2, 1, "assistant", hostile[3])]
    df = llm.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    out = chat.format_chats(df).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in out.collect():
        want = sorted([(t if t is not None else -1, role or "", text or "") for c, t, role, text in turns if c == r.conv_id],
                      key=lambda x: (x[0], x[1], chat_escape(x[2])))
        assert [(b.role, b.text) for b in r.back] == [(role, text) for _, role, text in want]
        assert r.loss == "".join(text for _, role, text in want if role == "assistant")
        assert r.n_turns == len(want)
    assert chat.format_chats(df.limit(0)).count() == 0


def chat_escape(text):
    import re

    return re.sub(r"([<\[])(~*/?(?:s|ROLE|INST|SYS|IMG|AUDIO|DOC|PAD)[>\]])", r"\1~\2", text)


def test_chat_attachments_in_order(llm):
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 33, "height": 16}, {"type": "audio", "ref": "b.wav", "seconds": 1.5},
             None, {"type": "document", "ref": "c.pdf", "pages": 2}, {"type": "image", "ref": None}, {"type": None, "text": "[IMG]"}]
    df = llm.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert r.formatted == "<s>[ROLE]user[/ROLE]see [IMG][AUDIO][DOC][IMG][~IMG]</s><s>[ROLE]user[/ROLE]</s>"
    assert [(a.kind, a.ref, a.nth, a.tokens) for a in r.attachments] == [("image", "a.png", 0, 4), ("audio", "b.wav", 1, 38), ("document", "c.pdf", 2, 512), ("image", None, 3, 1)]
    assert r.expanded_tokens == 555


# 2 substring


@pytest.mark.parametrize("options", [{}, {"depth": 1, "sketch_bits": 8}])
def test_substring_equals_brute_force(docs, rows, options):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept or "") for r in substring.dedup(docs.withColumn("kept", F.lit(1)), **options).collect())
    assert got == X.substring([(r[0], r[1]) for r in rows])


def test_substring_repeated_null_ids_and_empty(llm):
    text = prose(3, 50, 4000)
    df = llm.createDataFrame([(5, text), (5, text), (5, "x " + text), (None, text), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring.dedup(df).collect())
    n = len(X.blank_words(text))
    assert got == [(-1, n), (4, 0), (5, 0), (5, 0), (5, 0)]
    assert substring.dedup(df.limit(0)).count() == 0


def test_substring_clean_keeps_untouched_texts(docs, rows):
    out = {r.doc_id: r.text for r in substring.clean(docs).collect()}
    for d, n, gone, kept in X.substring([(r[0], r[1]) for r in rows]):
        assert out[d] == (rows[d][1] if not gone else kept)


# 3 packing


def test_best_fit_takes_the_tightest_compatible_bin():
    placed, fill = packing.best_fit([60, 50, 40, 40, 10], ["a", "b", "b", "a", None], [1, 2, 3, 4, 5], 100)
    # 40 of b cannot join b's 50, so it goes to the 60; 40 of a takes the bin of b's 50; 10 fills the tightest left
    assert placed == [0, 1, 0, 1, 1] and fill == [100, 100]


def test_packing_is_whole_and_without_conflicts(llm, rows):
    many = [(i, prose(i % 50, 20 + 37 * i % 900), None, f"s{i % 3}" if i % 7 else None, None) for i in range(600)] + [(1000 + r[0], *r[1:]) for r in [*rows, rows[0]]]
    df = llm.createDataFrame(many, SCHEMA).withColumn("bin_id", F.lit("clash"))
    out = packing.pack(df, capacity=1000, run=128).toPandas()
    words = {}
    for r in many:
        words.setdefault(r[0], []).append(len(X.blank_words(r[1])))
    assert out.groupby("doc_id")["size"].sum().to_dict() == {d: sum(n) for d, n in words.items()}
    assert (out.groupby("bin_id")["size"].sum() == out.groupby("bin_id")["bin_fill"].first()).all() and out["bin_fill"].max() <= 1000
    text, source = {r[0]: r[1] for r in many}, {r[0]: r[3] for r in many}
    for _, b in out.groupby("bin_id"):
        s = [source[d] for d in b["doc_id"] if source[d]]
        t = [text[d] for d in b["doc_id"] if text[d] is not None]
        assert len(set(s)) == len(s) and len(set(t)) == len(t)
        assert sorted(b["slot"]) == list(range(len(b)))
    assert packing.pack(df.limit(0)).count() == 0


# 4 simhash


def test_simhash_equals_brute_force(docs, rows):
    prints = {r[0]: X.simhash(r[1]) for r in rows}
    roots = X.groups(prints)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.group(docs.withColumn("fp", F.lit(0))).collect()}
    assert got == {d: (prints[d], roots[d]) for d in prints}
    kept = sorted(r.doc_id for r in simhash.clean(docs).collect())
    assert kept == sorted(set(roots.values()))
    assert simhash.group(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [8192, 3])
def test_simhash_links_lose_no_component(llm, cell, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(5)
    points = {0, (1 << 64) - 1}
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(12):
            points.add(p)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << b
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = llm.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = X.groups(dict(zip(signed, [p % (1 << 64) for p in signed])))
    assert {p: roots.get(p, p) for p in signed} == want


def test_manhattan_never_exceeds_hamming():
    a, b = (np.random.default_rng(i).integers(0, 1 << 63, 2000, dtype=np.uint64) for i in (1, 2))
    b = np.where(np.arange(2000) % 2, a ^ (b & (b >> np.uint64(1)) & (b >> np.uint64(2))), b)
    plain = [sum(abs((int(x) >> i & 3).bit_count() - (int(y) >> i & 3).bit_count()) for i in range(0, 64, 2)) for x, y in zip(a, b)]
    assert simhash.manhattan(simhash.embed(a), simhash.embed(b)).tolist() == plain
    assert (np.array(plain) <= np.bitwise_count(a ^ b)).all()


# 5 licenses


def test_license_scan_equals_full_alignment(llm):
    rng = random.Random(2)
    mit = license.TEMPLATES["MIT"]
    texts = [None, "", "nothing here " * 50, mit, "before Released under the MIT License. after", f"ä {prose(1, 30)} {mit.upper()} {mit}",
             " ".join(w for w in mit.split() if rng.random() > 0.08), " ".join(w if rng.random() > 0.1 else "zz" for w in mit.split()),
             " ".join(w if rng.random() > 0.5 else "zz" for w in mit.split()), "Released under the MIT", prose(4, 5000, 300) + " " + license.TEMPLATES["ISC"]]
    df = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licenses", F.lit(1))
    for r in license.scan(df).collect():
        got = {m.license: m for m in r.licenses}
        words = X.sign_words(r.text)
        for name, template in license.TEMPLATES.items():
            target = X.sign_words(template)
            score, matched = X.align(target, words)
            if name in got:
                assert got[name].matched == matched and got[name].coverage == matched / len(target)
                assert X.sign_words(r.text[got[name].char_start:got[name].char_end]) == words[got[name].first:got[name].end]
            else:
                assert matched < 0.8 * len(target), (r.doc_id, name)
    assert license.scan(df.limit(0)).count() == 0 and license.found(df).where("doc_id = 5 and license = 'MIT'").count() == 2


# 6 sharding


def test_rendezvous_moves_rows_only_to_the_new_shard(llm):
    df = llm.range(4000).select(F.when(F.col("id") % 1000 != 1, F.col("id")).alias("doc_id"), F.lit("x").alias("shard"))
    out = shard.assign(df, weights=[1.0, 2.0, 1.0], grown=2.0).toPandas()
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved["grown_shard"]) == {3} and abs(len(moved) / 4000 - 2 / 6) < 0.04
    assert (abs(out["shard"].value_counts(normalize=True).sort_index() - np.array([0.25, 0.5, 0.25])) < 0.04).all()
    assert out[out["doc_id"].isna()]["shard"].nunique() == 1
    again = shard.assign(df, weights=[1.0, 2.0, 1.0, 2.0], grown=None).toPandas()
    assert (again["shard"] == out["grown_shard"]).all()


def test_slots_are_gapless_ranks(llm):
    df = shard.assign(llm.range(3000).select(F.when(F.col("id") > 1000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit(3).alias("size")), shards=3, grown=None)
    out = shard.number(df, ["doc_id"], block_rows=100).toPandas()
    assert len(out) == 3000
    for _, s in out.groupby("shard"):
        s = s.sort_values("slot")
        assert s["slot"].tolist() == list(range(len(s))) and s["doc_id"].is_monotonic_increasing
    assert shard.number(df.limit(0), ["doc_id"]).count() == 0


SHARD_SQL = """
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce('k' || doc_id::VARCHAR, 'n')), 1, 13))::BIGINT % 2147483647 AS h FROM documents
), a AS (SELECT *, s, ((h + (s + 1) * 362437069) % 2147483647) * 1103515245 % 2147483647 AS x FROM d, range(41) r(s)),
b AS (SELECT *, xor(x, x >> 15) % 2147483647 * 1566083941 % 2147483647 AS y FROM a),
c AS (SELECT *, xor(y, y >> 13) % 2147483647 * 1812433253 % 2147483647 AS u FROM b),
w AS (SELECT doc_id, arg_max(s, u * 64 - s) FILTER (s < 40) AS shard, arg_max(s, u * 64 - s) AS grown FROM c GROUP BY doc_id)
SELECT doc_id, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, grown FROM w
"""


def test_sharding_query_equals_sql(llm, sf):
    import zlib

    import duckdb

    from voxelloom.llm.queries import op6_sharding

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(SHARD_SQL).fetchall()}
    text = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in op6_sharding(llm, sf).collect():
        assert (r.shard, r.slot, r.grown_shard) == want[r.doc_id]
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")


# 7 language


def test_language_is_told_on_held_out_documents(llm, sf):
    from voxelloom.llm.queries import op7_language

    told = op7_language(llm, sf).join(llm.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (told["lang_pred"] == told["lang"]).mean() >= 0.95 and told["score"].between(0, 1).all()


def test_language_rejects_and_edges(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    odd = llm.createDataFrame([(0, None), (1, ""), (2, "123 %% ..."), (3, "¿?"), (4, "the and of the with"), (4, "the and of the with"), (5, "der die das und " * 90000)],
                              "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = sorted((r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect())
    assert got == [(0, "und"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    kept = langid.clean(odd, model)
    assert kept.columns == odd.columns and sorted((r.doc_id, r.score) for r in kept.collect()) == [(4, "mine"), (4, "mine"), (5, "mine")]
    assert langid.fit(docs.where("false")) is None and langid.predict(odd, None).where("lang_pred <> 'und'").count() == 0


# 8 decontamination


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (50, 1, 7, 120, 120)] + [np.append(np.ones(64, int), 0)])
    index = fmindex.FMIndex(text, 4)
    for n in (1, 2, 5, 9):
        patterns = np.unique(rng.integers(1, 4, (40, n)), axis=0)
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i:i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block_bytes", [16 << 20, 900])
def test_decontamination_equals_brute_force(llm, docs, rows, block_bytes):
    items = [(1, prose(0, 200, 4000)[300:700]), (2, "two"), (3, None), (4, ""), (5, prose(99, 60, 4000)), (6, rows[6][1]), (7, rows[6][1]), (8, "?!"),
             (9, prose(7, 30000, 20000)[9000:9400])]
    df = llm.createDataFrame([*items, (None, "three")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.scan(docs.withColumn("n_hit", F.lit(1)), df, block_bytes=block_bytes, shard_words=500).collect()}
    assert got == X.decontaminate([(r[0], r[1]) for r in rows], [i for i in items if i[1]])
    assert decontam.scan(docs, df.limit(0)).agg(F.sum("n_hit")).first()[0] == 0 and decontam.scan(docs.limit(0), df).count() == 0


def test_removal_spans_cut_the_hit_words(llm, docs, rows):
    items = llm.createDataFrame([(1, rows[5][1]), (2, prose(99, 60, 4000))], "item_id long, text string")
    scanned = decontam.scan(docs, items)
    for r in decontam.cut(scanned.withColumn("old", F.col("text"))).collect():
        assert len(X.sign_words(r.old)) - r.n_hit == len(X.sign_words(r.text))
    dirty = {r.doc_id for r in scanned.where(decontam.contaminated()).collect()}
    assert dirty and {r.doc_id for r in decontam.clean(docs, items).collect()} == {r[0] for r in rows} - dirty


# 9 token ids


def test_token_files_round_trip(llm, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    extra = ["  a  b\n c \n\n d", "x  y  　z ", "<|endoftext|> hi  <|endoftext|>", " 's it's  ", "\t\ta b\x1c c", "a\x0bb \x0b c", " \x85 q", "é é  é\n"]
    many = [(r[0], r[1]) for r in rows] + [(100 + i, t) for i, t in enumerate(extra)] + [(None, "no id"), (50, "b"), (50, "a")]
    df = llm.createDataFrame(many, "doc_id long, text string").withColumn("key", F.lit(1)).repartition(4)
    manifest = tokens.write(df, tokens.folder(df), path, 2, length=64, rows=4, file_bytes=20000)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read(manifest).collect()))
    assert [r[1] for r in got][0] is None and [r[1] for r in got][1:] == sorted(d for d, _ in many if d is not None)
    want = {}
    for d, t in many:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(d, []).append((len(ids), X.crc(ids)))
    at = 0
    for start, d, n, crc in got:
        assert start == at and (n, crc) in want[d]
        at += n
    file = manifest.orderBy("start").first()
    reader = tokens.opened(file.path)
    ids, mask = tokens.sequence(reader, 5, rows=4)
    flat = np.concatenate([tokens.sequence(reader, i, rows=4)[0] for i in range(file.n_rows)])
    assert len(ids) == 64 and mask.all() and (flat[5 * 64:6 * 64] == ids).all() and not ids.flags.owndata
    assert tokens.read(tokens.write(df.limit(0), tokens.folder(df), path, 2)).count() == 0


# 10 top-k


def test_top_k_equals_brute_force(llm):
    rng = np.random.default_rng(1)
    vectors = [(int(i), (rng.normal(size=8) * (1 + i % 3)).astype(np.float32).tolist()) for i in range(700)]
    vectors += [(1000 + i, vectors[i][1]) for i in range(60)] + [(2000, [1.0] * 3), (2050, [0.5] * 3), (2100, [float("nan")] * 8), (2150, None), (2200, [None] * 8),
                                                                   (2250, [float("inf")] * 8), (2300, []), (2350, [3e38] * 8), (None, [1.0] * 8), (50, vectors[50][1])]
    df = llm.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top(df, query=F.col("vec_id") % 50 == 0, annulus=16, pivots=5, sample=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    sound = [(i, [max(min(math.floor(256 * x), 1 << 31), -(1 << 31)) for x in v]) for i, v in vectors
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in sound:
        if q % 50:
            continue
        best = {}
        for c, u in sound:
            if c != q and len(u) == len(v):
                score = max(min(sum(a * b for a, b in zip(v, u)), (1 << 63) - 1), -(1 << 63))
                best[c] = max(best.get(c, score), score)
        want = sorted(((-s, c) for c, s in best.items()))[:5]
        assert sorted(got.get(q, [])) == [(i + 1, c, -s) for i, (s, c) in enumerate(want)], q
    assert topk.top(df.limit(0)).count() == 0


def test_columns_with_clashing_names_come_through(llm, docs, sf):
    """Filters and cleaners keep every column of their input, whatever it is called."""
    odd = docs.where("doc_id < 8").withColumns({c: F.lit(c) for c in ("n_words", "N_Hit", "kept", "removed", "items", "score", "lang_pred", "fp", "key", "component_id")})
    items = llm.createDataFrame([(1, "no such words here at all")], "item_id long, text string")
    model = langid.fit(llm.read.parquet(f"{sf}/documents.parquet"))
    for out in (substring.clean(odd), decontam.clean(odd, items), simhash.clean(odd), langid.clean(odd, model)):
        assert out.columns == odd.columns
        row = out.orderBy("doc_id").first()
        assert row["n_words"] == "n_words" and row["kept"] == "kept" and row["score"] == "score" and row["N_Hit"] == "N_Hit"
    clash = llm.createDataFrame([(1, "Released under the MIT License.", "a", "b")], "doc_id long, text string, license string, m string")
    assert license.found(clash).first().license == "MIT statement"
