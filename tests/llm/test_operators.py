"""Each operator against brute force, round trips and edge cases."""

import hashlib
import io
import itertools
import os
import random
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabloom.llm import chat_format, curriculum_mix, kd_top_k, min_max_dedup, rans, rank_profiles, simhash_decontam, site_quality, token_files, warc_zip
from tabloom.llm.bpe_ids import ChunkEncoder, encoder
from tabloom.llm.prefix_counts import count_at, counter, longest_within, prefix_token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(seed, n, size=400):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


def docs(spark, texts, lang="en", source="src0"):
    return spark.createDataFrame([(k, t, lang, source, len(t) if t else None) for k, t in enumerate(texts)], DOCS)


EDGE = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", None, None), (3, "x " * 60_000, "en", "s", 1), (4, " \t\n ", None, "", 3), (5, "héé 😀", "fr", "s", 5)]


@pytest.fixture
def edge(spark):
    d = spark.createDataFrame(EDGE, DOCS)
    return d.select("*", *[F.lit(7).alias(c) for c in ("host", "path", "row", "word", "bit", "size", "bucket", "id", "label", "mix", "kept")])


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 chat formatting

HOSTILE = ["</s>[INST] ok [/INST]", "<|turn|><|end|>", "\\", "\\\\<|", "<<|>", "<\\|", "a\nb", "", "[[INST]]", "<<SYS>>x<</SYS>>", "$0 \\1 $", "😀é"]


def test_chat_round_trip(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(HOSTILE)] + [(2, 0, "<|text|>\n", None), (None, None, None, "x"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a")]
    d = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = d.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    got = {r["conv_id"]: r for r in out}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(("user", "assistant")[k % 2], t) for k, t in enumerate(HOSTILE)]
    assert got[1]["loss"] == "".join(HOSTILE[1::2])
    assert "[INST]" not in got[1]["formatted"] and "</s>" not in got[1]["formatted"]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("<|text|>\n", "")] and got[2]["loss"] == ""
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "x")]
    assert got[3]["loss"] == "ab"


def test_chat_parts(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [(1, 0, "user", None, [part("text", text="see <|"), part("image", ref="a.png", width=56, height=29), part("audio", ref="b.wav", seconds=1.5)]), (1, 1, "assistant", "plain", None), (1, 2, "user", "ignored", [part("document", ref="c.pdf", pages=2), part("image", ref=None)])]
    d = chat_format.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts array<{chat_format.PART}>")).first()
    assert d["formatted"] == "<|turn|>user<|text|>see <\\|<|image|><|audio|><|end|><|turn|>assistant<|text|>plain<|end|><|turn|>user<|text|><|document|><|image|><|end|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in d["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 512), ("image", None, 0)]
    assert d["expanded_tokens"] == 554


def test_chat_empty(spark):
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 2 token files

def test_rans_round_trip():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 31, 32, 33, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK + 17):
        ids = np.minimum(rnd.geometric(0.01, n) - 1, 999).astype(np.uint32)
        table = rans.Table(rans.quantise(np.bincount(ids, minlength=1000)))
        file = io.BytesIO(b"".join(rans.shard_bytes([n // 2, n - n // 2], ids, table)))
        footer = rans.read_footer(file)
        got = rans.read_blocks(file, footer, table)
        assert np.concatenate([*got, np.empty(0, np.uint32)]).tolist() == ids.tolist()
        if len(footer["blocks"]) > 2:  # a block alone, from its checkpoint
            assert rans.read_blocks(file, footer, table, 1, 2)[0].tolist() == ids[rans.BLOCK : 2 * rans.BLOCK].tolist()
            broken = bytearray(file.getvalue())
            broken[footer["blocks"][1][0] + 500] ^= 1
            with pytest.raises(ValueError, match="damaged"):
                rans.read_blocks(io.BytesIO(bytes(broken)), footer, table)


def test_rans_table():
    freq = rans.quantise(np.array([0, 5, 10**12, 1]))
    assert freq.sum() == 1 << rans.SCALE_BITS and freq.min() >= 1
    assert rans.quantise(np.zeros(5)).sum() == 1 << rans.SCALE_BITS


ODD = ["", " ", "  ", "\n", "don't we'll they're 'stop it'S", " \n x", "a  b   c\t\td", "tail  ", "\x1c\x1d x\x85y", "a <|endoftext|>b <|endof", "!!<|endoftext|>  x", "日本語 テキスト😀😀", "\t'll \n've 're", "x" * 300 + " y" * 50]


def oddities():
    rnd, parts = random.Random(1), list(" \n\t'srevlldmabcXYZ019.,!<|> é日😀\x1c") + ["  ", "'ll", "<|endoftext|>", " the"]
    return ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(300)]


def test_encoder_is_the_library():
    e = encoder(PATH, PATTERN)
    for t in oddities():
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == e.whole.encode(t, add_special_tokens=False).ids, t


def test_words_are_put_to_the_model_once():
    """Whatever marks stand behind them, and at whichever of two line ends."""
    import pyarrow as pa

    e, asked = ChunkEncoder(PATH, PATTERN), []
    model, words = e.model, ["alpha", "déjà", "Žižek", "beta7"]

    class Counting:
        def tokenize(self, text):
            asked.append(text)
            return model.tokenize(text)

    e.model = Counting()
    texts = [f"{a}{m} {a}{n} {b}\n{b}{m}" for a in words for b in words for m in ("", ".", "###", "!?") for n in (",", ")...", "-")]
    others = ["a", "...", "...a", "x\n...", "it's. don't! 'tis'. 12.5% a'.", "eж. ж", "alpha's alpha' beta7'.", "".join(f"w{k}. " for k in range(3000)) + "end"]
    for some in (texts, texts[3:], others):
        got = e.encode_all(pa.array(["not these", *some]).slice(1)).to_pylist()
        assert [np.frombuffer(g, e.dtype).tolist() for g in got] == [i.ids for i in e.whole.encode_batch(some, add_special_tokens=False)]
        assert some is others or len(asked) == len(set(asked))


def test_token_files(spark, edge):
    got = sorted(token_files.token_digests(edge, PATH, PATTERN).collect(), key=lambda r: r["start"])
    whole = encoder(PATH, PATTERN).whole
    at = 0
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 4, 5]
    for r, text in zip(got, [None, "", "", None, *[e[1] for e in EDGE[4:]]]):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_empty(empty):
    assert token_files.token_digests(empty, PATH, PATTERN).count() == 0


# 3 prefix counts

def test_prefix_table_is_exact_at_every_prefix():
    c, whole = counter(PATH, PATTERN), encoder(PATH, PATTERN).whole
    for t in oddities():
        want = [len(whole.encode(t[:k], add_special_tokens=False).ids) for k in range(1, len(t) + 1)]
        assert np.cumsum(np.frombuffer(c.table(t), np.int8), dtype=int).tolist() == want, t


def test_budget_questions():
    table = counter(PATH, PATTERN).table("one two three")
    assert count_at(table) == 3 and count_at(table, 3) == 1 and longest_within(table, 2) == 7 and longest_within(b"", 5) == 0


def test_prefix_counts(spark, edge, empty):
    whole = encoder(PATH, PATTERN).whole
    got = prefix_token_counts(edge, PATH, PATTERN, keep_table=True).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(whole.encode(e[1] or "", add_special_tokens=False).ids) for e in EDGE)
    assert all(count_at(bytes(r["prefix_steps"])) == r["n_tokens"] and r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert prefix_token_counts(empty, PATH, PATTERN).count() == 0


# 4 top k

def brute_top(vectors, asked, k):
    out = []
    for q in asked:
        scores = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(kd_top_k, "SHARD_ROWS", 100)
    monkeypatch.setattr(kd_top_k, "BLOCK_ROWS", 7)
    rnd = np.random.default_rng(5)
    vectors = {i: rnd.integers(-3, 4, 6).tolist() for i in range(420)} | {1000 + i: [3, 3, 3, 0, 0, 0] for i in range(150)}
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()]
    odd = [(None, [1.0] * 6), (5000, None), (5001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5002, [float("nan")] * 6), (5003, [float("inf")] * 6), (5004, [])]
    d = spark.createDataFrame(rows + odd, "id long, v array<double>")
    got = kd_top_k.top_k(d, d.where("id % 20 = 0"), 20)
    asked = [i for i in vectors if i % 20 == 0]
    assert sorted(tuple(r) for r in got.collect()) == brute_top(vectors, asked, 20)
    few = d.where("id < 3")
    assert kd_top_k.top_k(few, few.where("id = 0"), 20).count() == 2
    assert kd_top_k.top_k(d.where("id < 0"), d, 20).count() == 0


def test_top_k_refuses_mixed_lengths(spark):
    d = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [1.0, 1.0, 1.0])], "id long, v array<double>")
    for vectors, queries in ((d, d.where("id < 2")), (d.where("id < 9"), d)):
        with pytest.raises(ValueError, match="mixed lengths, from 2 to 3"):
            kd_top_k.top_k(vectors, queries, 2)
    assert kd_top_k.top_k(d.where("id < 9"), d.where("id < 2"), 2).count() == 4


# 5 language

def test_gram_keys():
    keys = rank_profiles.gram_keys("Ab, b")
    assert sorted(np.unique(keys, return_counts=True)[1].tolist()) == [1, 1, 1, 1, 1, 1, 1, 2, 2]  # a ab ␣a ␣b ␣ab ab␣ ␣b␣; b, b␣ twice
    assert len(rank_profiles.gram_keys("12 !")) == 0


def test_language(spark, edge, empty):
    fr, en = "le la une être à où déjà français", "the of and which where thing going"
    train = spark.createDataFrame([(" ".join(random.Random(k).sample(t.split(), 5)), lang) for k in range(20) for t, lang in ((fr, "fr"), (en, "en"))], "text string, lang string")
    d = docs(spark, ["the thing", "la être", None, "123 !", "THE WHICH"])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rank_profiles.identify_language(d, train).collect()}
    assert [got[k][0] for k in range(5)] == ["en", "fr", "und", "und", "en"] and got[2][1] == 0 and 0 < got[0][1] <= 1
    assert rank_profiles.identify_language(edge, edge).count() == len(EDGE)
    assert {r["lang_pred"] for r in rank_profiles.identify_language(d, empty).collect()} == {"und"}
    assert rank_profiles.identify_language(empty, train).count() == 0


def test_profiles_against_brute_force(spark):
    texts = [" ".join(words(k, 50, 60)).replace("w", chr(97 + k % 7)) + " abc" * 5 for k in range(30)]
    learnt = rank_profiles.learn_profiles(docs(spark, texts))
    keys, counts = np.unique(np.concatenate([rank_profiles.gram_keys(t) for t in texts]), return_counts=True)
    assert learnt["en"].tolist() == [k for _, k in sorted(zip((-counts).tolist(), keys.tolist()))][: rank_profiles.PROFILE]


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    r = rank_profiles.identify_language(d.where(held), d.where(~held)).join(d.select("doc_id", "lang"), "doc_id")
    assert r.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


# 6 decontamination

def brute_leaks(texts, items, least=0.8):
    out = set()
    for d, t in texts.items():
        p = simhash_decontam.words(t)
        for i, item in items.items():
            q = simhash_decontam.words(item)
            if not p or not q:
                continue
            n = min(len(q), len(p))
            if not {*simhash_decontam.shingle_list(q)} & {x for w in {min(5, len(q)), min(5, n)} for x in simhash_decontam.shingle_list(p, w)}:
                continue  # without a common shingle the similarity is 0
            if any(simhash_decontam.weighted_similarity(simhash_decontam.shingle_list(q), simhash_decontam.shingle_list(p[s : s + n])) >= least for s in range(len(p) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    items = {k: " ".join(words(k, 12 + 5 * k, 5000)) for k in range(10)} | {50: "only three words", 51: "", 52: "!!"}
    texts = {}
    for k in range(60):
        base, item = words(100 + k, 80, 5000), items[k % 10].split()
        if k % 3 == 0:
            item[len(item) // 2 if k % 2 else 0] = "changed"
        texts[k] = " ".join(base[:30] + (item if k % 4 else item[: len(item) // 2]) + base[30:])
    texts |= {70: "It has only, THREE words!", 71: None, 72: "", 73: items[4].upper().replace(" ", ", "), 74: " ".join(items[9].split()[1:])}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    b = spark.createDataFrame([*items.items(), (None, "x y z"), (60, None)], "item_id long, text string")
    got = simhash_decontam.benchmark_leaks(d, b).collect()
    want = brute_leaks(texts, items)
    assert len(want) > 30 and {(r["doc_id"], r["item_id"]) for r in got} == want
    clean = {r["doc_id"] for r in simhash_decontam.decontaminate(d, b).collect()}
    assert clean == texts.keys() - {d for d, _ in want}


def test_hamming_index_finds_all_within_radius():
    rnd = random.Random(2)
    stored = [rnd.getrandbits(64) for _ in range(50)]
    index = simhash_decontam.HammingIndex(np.array(stored, np.uint64))
    for _ in range(300):
        q = stored[rnd.randrange(50)]
        for b in rnd.sample(range(64), rnd.randint(0, 25)):
            q ^= 1 << b
        assert index.within(q) == {k: (s ^ q).bit_count() for k, s in enumerate(stored) if (s ^ q).bit_count() <= simhash_decontam.RADIUS}


def test_decontaminate_edges(edge, empty, spark):
    b = spark.createDataFrame([(1, "some item of five words")], "item_id long, text string")
    assert simhash_decontam.decontaminate(edge, b).count() == len(EDGE) and simhash_decontam.decontaminate(edge, b).columns == edge.columns
    assert simhash_decontam.benchmark_leaks(edge, b.where("false")).count() == 0 and simhash_decontam.benchmark_leaks(empty, b).count() == 0


def test_benchmark_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash_decontam, "CHUNK_WORDS", 40)
    items = {k: " ".join(words(k, 30, 5000)) for k in range(5)}
    d = spark.createDataFrame([(k, f"a {t} b") for k, t in items.items()], "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert len([*simhash_decontam.benchmark_chunks(b)]) == 5
    assert {(r["doc_id"], r["item_id"]) for r in simhash_decontam.benchmark_leaks(d, b).collect()} == {(k, k) for k in items}
    assert simhash_decontam.decontaminate(d, b).count() == 0


# 7 quality

def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    judged = site_quality.classify_quality(d, labels.where(~out)).select("row.doc_id", "kept").join(labels.where(out), "doc_id")
    r = judged.select(F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("toxic") == 1, F.col("kept").cast("int"))).alias("toxic"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("poor")).first()
    assert r["good"] > 0.97 and r["toxic"] < 0.03 and r["poor"] < 0.03


def test_site_posteriors_shrink(spark):
    rows = [("a", "a/x", 0.9)] * 200 + [("b", "b/x", 0.1)] * 200 + [("c", "c/x", 0.9)] * 2
    sites = {r["path"]: r for r in site_quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    mean = (200 * 0.9 + 200 * 0.1 + 1.8) / 402
    assert abs(sites["a/x"]["global_mean"] - mean) < 1e-9
    assert mean < sites["c/x"]["host_mean"] < sites["a/x"]["host_mean"] < 0.9


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, None), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert site_quality.classify_quality(edge, labels).count() == len(EDGE)
    kept = site_quality.keep_good(edge, labels.where("false"))
    assert kept.count() == len(EDGE) and kept.columns == edge.columns
    assert site_quality.keep_good(empty, labels).count() == 0


# 8 near duplicates

def brute_components(texts, width, share):
    sets = {}
    for k, t in texts:
        p = min_max_dedup.words(t)
        s = {tuple(p[j : j + width]) for j in range(max(1, len(p) - width + 1))} if p else set()
        sets.setdefault(k, []).append(s)
    label = {k: k for k in sets}
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= share * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {k: find(k) for k in sets}


def chained(n, step, start=0):
    """Texts of which each is near the next, but not the ones after."""
    base = words(9 + start, 60 + n * step, 9000)
    return [" ".join(base[k * step : k * step + 60]) for k in range(n)]


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(min_max_dedup, "BLOCK_ROWS", block)
    base = words(1, 120, 9000)
    texts = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(0, 100, 4)]
    texts += [" ".join(base[:k] + words(k, 9 + k % 5, 9000) + base[k + 9 :]) for k in range(0, 100, 3)]
    texts += chained(25, 3) + chained(25, 6, 1) + ["a b", "A b", "a b c", "", None, "a  b\n", "x y z v w"] * 2 + [" ".join(words(500 + k, 40, 9000)) for k in range(30)]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    rows += [(3, "a repeated id"), (3, "a repeated id"), (900, "a repeated id")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = min_max_dedup.near_duplicates(d, width=4, share=80).collect()
    want = brute_components(rows, 4, 80)
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = min_max_dedup.deduplicate(d, width=4, share=80).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_near_duplicates_edges(spark, edge, empty):
    got = min_max_dedup.near_duplicates(edge).collect()
    assert len(got) == len(EDGE) and [r for r in got if r["doc_id"] is None][0]["kept"]
    out = min_max_dedup.deduplicate(edge)
    assert out.columns == edge.columns and sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 1, 2, 3, 4, 5]
    assert min_max_dedup.near_duplicates(empty).count() == 0 and min_max_dedup.deduplicate(empty).count() == 0


def test_components(spark):
    rnd = random.Random(8)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: r["label"] for r in min_max_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in label.items())


# 9 archives

def test_archive_read_by_range():
    records = [(k, warc_zip.warc_record(k, f"http://x/{k}\n", b"p" * k, hashlib.sha256(b"p" * k).hexdigest(), None)) for k in range(30)]
    for zip64 in (True, False):
        data = b"".join(warc_zip.archive_bytes(iter(records), zip64))
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and z.namelist() == [warc_zip.DATA, warc_zip.INDEX] and all(i.compress_type == 0 for i in z.infolist())
        got = [*warc_zip.Archive(io.BytesIO(data + b"")).records()]
        assert [r["payload"] for r in got] == [b"p" * k for k in range(30)] and got[3]["WARC-Target-URI"] == "http://x/3%0A"
        for broken in (data[:-30], data[: len(data) // 2], b"", b"PK\x05\x06" + b"\0" * 18):
            with pytest.raises(warc_zip.ArchiveError):
                [*warc_zip.Archive(io.BytesIO(broken)).records()]


def test_archive_by_another_writer():
    record = warc_zip.warc_record(4, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    import gzip
    packed, out = gzip.compress(record), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        z.writestr(warc_zip.DATA, packed)
        z.writestr(warc_zip.INDEX, '{"id": 4, "offset": 0, "length": %d}' % len(packed))
        z.comment = b"a comment PK\x05\x06 in it"
    a = warc_zip.Archive(out)
    assert [r["payload"] for r in a.records()] == [b"hello"]
    with pytest.raises(warc_zip.ArchiveError, match="not stored"):
        a.stored("datapackage.json")


def test_page_records(spark):
    big = "é" * 60
    rows = [(5, "u", big), (3, "u", big), (9, None, big), (None, "u", big), (1, "u", "tiny"), (2, "u", "tiny"), (4, "u", None), (6, "u", ""), (3, "u", big), (7, "u", "z" * 100_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("size", F.lit(2))
    got = sorted([tuple(r) for r in warc_zip.page_records(d).collect()], key=str)
    def want(i, html):
        data = (html or "").encode()
        again = html == big and i != 3
        return i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None
    assert got == sorted([want(i, h) for i, _, h in rows], key=str)
    assert warc_zip.page_records(d.where("false")).count() == 0


# 10 mixing

def fill(sizes, weights, total, most):
    target, open_ = {}, set(sizes)
    while open_:
        rest, w = total - sum(target.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if rest * weights[s] / w > most * sizes[s]]
        if not over:
            target |= {s: rest * weights[s] / w for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        open_ -= set(over)
    return target


def test_mix(spark):
    rnd = random.Random(6)
    rows = [(k, " ".join(["w"] * rnd.randint(0, 90)), None if k % 7 == 0 else f"s{rnd.choice('abcdefé')}") for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("mine"))
    got = curriculum_mix.curriculum_mix(d).select("doc_id", "source", "size", "mix.*").toDF("doc_id", "source", "own", "size", "source_size", "target", "copies", "taken", "positions").collect()
    size = {k: len(t.split()) for k, t, _ in rows}
    sums = {}
    for k, _, s in rows:
        sums[s] = sums.get(s, 0) + size[k]
    names = sorted(sums, key=lambda s: (s is None, (s or "").encode("utf-8")))
    target = fill(sums, {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}, 1.5 * sum(sums.values()), 2)
    taken = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * target[r["source"]] and r["own"] == "mine"
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())
    again = curriculum_mix.curriculum_mix(d.repartition(7)).select("doc_id", "mix.positions").collect()
    assert {r["doc_id"]: r["positions"] for r in again} == {r["doc_id"]: r["positions"] for r in got}
    mixture = curriculum_mix.mixture(d)
    assert mixture.columns == d.columns and mixture.count() == sum(r["copies"] for r in got)


def test_mix_fills_the_rest(spark):
    rnd = random.Random(8)
    rows = [(k, " ".join(["w"] * rnd.randint(3, 40)), f"s{k % 3}") for k in range(3000)]
    rows += [(3000 + 10 * n + k, " ".join(["w"] * size), f"s{n}") for n in range(3) for k, size in enumerate((9_000, 25_000, 60_000))]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = curriculum_mix.curriculum_mix(d).select("doc_id", "source", "mix.*").collect()
    for s in ("s1", "s2"):  # s0 is taken twice as a whole
        mine = [r for r in got if r["source"] == s]
        full = int(mine[0]["target"] / mine[0]["source_size"])
        gap = mine[0]["target"] - sum(r["taken"] for r in mine)
        assert full < 2 and -1e-6 < gap < min(r["size"] for r in mine if r["size"] and r["copies"] == full)
        places = [p for r in mine for p in r["positions"]]
        assert all(0 <= p <= 1 for p in places) and len(set(places)) == len(places)


def test_schedule_inversion(spark):
    for knots in [*curriculum_mix.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (0.6, 0.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0))]:
        whole = curriculum_mix.integral(knots)
        def reached(t, knots=knots):
            out = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                x = min(max(t - t0, 0.0), t1 - t0)
                out += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            return out
        for r in spark.range(101).select((F.col("id") / 100).alias("s"), curriculum_mix.invert(knots, F.col("id") / 100).alias("t")).collect():
            assert abs(reached(r["t"]) / whole - r["s"]) < 1e-9
    with pytest.raises(ValueError):
        curriculum_mix.check_schedule(((0.0, 1.0), (0.5, 1.0)))


def test_mix_edges(spark, edge, empty):
    got = curriculum_mix.curriculum_mix(edge).collect()
    assert len(got) == len(EDGE) and {r["mix"]["source_size"] for r in got if r["source"] is None} == {0}
    assert curriculum_mix.curriculum_mix(empty).count() == 0
    assert curriculum_mix.mixture(empty).columns == empty.columns


# the pipeline

def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    rows = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in site_quality.keep_good(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    part = brute_components([(k, docs[k]["text"]) for k in good], 5, 80)
    single = {k for k in good if part[k] == k}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = single - {d for d, _ in brute_leaks({k: docs[k]["text"] for k in single}, items)}
    assert rows.keys() <= clean and len(rows) > 0.3 * len(clean)
    whole = encoder(PATH, PATTERN).whole
    assert all(n == len(whole.encode(docs[k]["text"], add_special_tokens=False).ids) + 1 for k, n in rows.items())


def test_token_rows_of_a_repeated_document(spark):
    d = docs(spark, ["one two", "three"])
    assert sorted(r["doc_id"] for r in token_files.token_digests(d.unionByName(d.where("doc_id = 0")), PATH, PATTERN).collect()) == [0, 0, 1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no data")
def test_sql_of_queries(spark):
    import duckdb

    from tabloom.llm.queries import ORACLE_SQL, QUERIES

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for name in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        ran = con.execute(sql)
        columns = sorted(d[0] for d in ran.description)
        at = [[d[0] for d in ran.description].index(c) for c in columns]
        want = sorted(([r[k] for k in at] for r in ran.fetchall()), key=str)
        frame = QUERIES[name](spark, sf)
        assert sorted(frame.columns) == columns
        assert sorted(([r[c] for c in columns] for r in frame.collect()), key=str) == want, name
