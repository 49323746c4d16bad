"""What operators make of wide ids, nulls, repeated rows, hot keys, many sources and foreign files."""

import gzip
import io
import itertools
import json
import math
import os
import random
import subprocess
import sys
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabloom.llm import chat_format, curriculum_mix, kd_top_k, min_max_dedup, rank_profiles, simhash_decontam, site_quality, token_files, warc_zip
from tabloom.llm.bpe_ids import encoder
from tabloom.llm.common import TwoGenerations, cut, file_order, join_hot, running_sums
from tabloom.llm.prefix_counts import counter, prefix_token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
A, B = (1 << 60) + 1, (1 << 60) + 3  # two ids that one double can't tell apart
BODY = "the first of two texts that share all of their many words but for the last, which is "


def words(seed, n, size=5000):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


# Ids above 2**53 beside null ones


@pytest.fixture
def wide(spark):
    rows = [(A, "some text here", "en"), (None, "no id", "en"), (B, "another text", "en"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)


def ids_of(frame):
    return sorted((r["doc_id"] for r in frame.collect()), key=lambda x: (x is not None, x))


def test_wide_ids_stay(spark, wide):
    want = [None, None, A, B]
    assert ids_of(token_files.token_digests(wide, PATH, PATTERN)) == want
    assert ids_of(prefix_token_counts(wide, PATH, PATTERN)) == want
    assert ids_of(rank_profiles.identify_language(wide, wide)) == want
    found = {r["doc_id"]: r["component_id"] for r in min_max_dedup.near_duplicates(wide).collect()}
    assert found == {None: None, A: A, B: B}
    assert ids_of(min_max_dedup.deduplicate(wide)) == want


def test_wide_ids_of_leaks(spark):
    item = words(1, 20)
    d = spark.createDataFrame([(None, item), (A, item), (B, "clean")], "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(A, item), (None, "x y z u v")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in simhash_decontam.benchmark_leaks(d, b).collect()}
    assert got == {(None, A), (A, A)}
    assert ids_of(simhash_decontam.decontaminate(d, b)) == [B]


def test_wide_ids_of_pages(spark):
    html = "x" * 200
    rows = [(A, "u", html), (None, "u", html), (B, "u", html), (None, "u", None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc_zip.page_records(d).collect()), key=str)
    assert got == sorted([(A, "response", None), (B, "revisit", A), (None, "revisit", A), (None, "response", None)], key=str)


# Shared pieces


def test_join_hot(spark):
    rows = [(k % 7 if k % 3 else 99, k) for k in range(600)] + [(1000, 1)]
    d = spark.createDataFrame(rows, "key long, v long")
    g = d.where("key < 1000").groupBy("key").agg(F.count("*").alias("c"), F.max("v").alias("m"))
    want = sorted(map(tuple, d.join(g, "key").select("key", "v", "c", "m").collect()))
    for keys in ("key", ["key"]):
        assert sorted(map(tuple, join_hot(d, g, keys, "c", least=50).select("key", "v", "c", "m").collect())) == want
    assert join_hot(d.where("false"), g.where("false"), "key", "c").count() == 0


def test_running_sums(spark):
    rows = [(random.Random(k).randrange(50), k) for k in range(300)]
    got = running_sums(spark.createDataFrame(rows, "a long, b long"), [F.col("a"), F.col("b")], {"b": "before"}, "place").collect()
    total = 0
    for n, ((a, b), r) in enumerate(zip(sorted(rows), sorted(got, key=lambda r: r["place"]))):
        assert (r["a"], r["b"], r["place"], r["before"]) == (a, b, n, total)
        total += b


def test_memos_are_bounded_by_bytes():
    made = []
    memo = TwoGenerations(lambda k: made.append(k) or k.encode(), 100_000)
    for k in range(5_000):
        assert memo[f"key {k}"] == f"key {k}".encode()
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for held in (memo, memo.old) for k, v in held.items()) < 120_000
    memo["x" * 300], memo["x" * 300]
    assert made[-2:] == ["x" * 300] * 2 and "x" * 300 not in memo


def test_file_order(spark):
    d = spark.range(1000).withColumn("r", F.xxhash64("id"))
    placed, order = file_order(cut(d.orderBy("r"), "ordered"), ["r"])
    rows = [r["r"] for r in placed.orderBy(*order).collect()]
    assert rows == sorted(rows) and len(rows) == 1000
    assert file_order(d, ["r"])[1] is None


# 1 chat formatting


def test_equal_turns_stand_by_their_text(spark):
    rows = [(1, 0, "user", "z", 1), (1, 0, "user", "<|a", 2), (1, None, "b", None, 3), (2, 0, "assistant", "<s>" * 200_000, 4)]
    names = "conv_id long, turn long, role string, text string, "
    d = spark.createDataFrame(rows, names + "piece long").select("*", *[F.lit(1).alias(c) for c in ("body", "said", "said_by", "head", "place", "learn", "start")])
    out = {r["conv_id"]: r for r in chat_format.format_chats(d).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["t"]] == [("b", ""), ("user", "<|a"), ("user", "z")]
    assert out[2]["loss"] == "<s>" * 200_000


def test_a_table_with_parts_goes_through_the_query(spark, tmp_path):
    from tabloom.llm.queries import op1_chat_format

    part = ("image", None, "a.png", 56, 28, None, None)
    d = spark.createDataFrame([(1, 0, "user", None, [part]), (1, 1, "assistant", "t", None)], f"conv_id long, turn long, role string, text string, parts array<{chat_format.PART}>")
    d.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op1_chat_format(spark, str(tmp_path)).collect()}
    assert (got[1]["n_attachments"], got[1]["expanded_tokens"], got[1]["loss_chars"]) == (1, 2, 1) and got[-7]["n_turns"] == 2


# 2 token files


def test_a_fresh_session_decodes_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 3_000)
    monkeypatch.setattr(token_files, "SPAN_IDS", 700)
    texts = [words(k, 5 + 40 * (k % 9)) for k in range(60)] + ["same text"] * 300 + [words(999, 6_000), None]
    rows = [(k if k % 2 else None, t) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = token_files.write_token_files(d, PATH, PATTERN, folder=f"{tmp_path}/out")
    assert len([n for n in os.listdir(folder) if n.endswith(".rtok")]) > 5
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from tabloom.llm.token_files import read_token_files
import json
print("ROWS", json.dumps([[r.doc_id, r.start, list(r.ids)] for r in read_token_files(spark, {folder!r}).collect()]))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300).stdout
    got = sorted(json.loads(said.partition("ROWS ")[2]), key=lambda r: r[1])
    whole = encoder(PATH, PATTERN).whole
    ids = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 2]
    assert [r[0] for r in got] == sorted([k for k, _ in rows], key=lambda k: (k is not None, k))
    assert sorted(([r[0], r[2]] for r in got), key=str) == sorted(([k, ids(t)] for k, t in rows), key=str)
    assert [r[1] for r in got] == list(itertools.accumulate([0, *(len(r[2]) for r in got[:-1])]))


def test_token_files_in_another_order(spark):
    d = spark.createDataFrame([(k, f"text {k}", (k * 7) % 10) for k in range(10)], "doc_id long, text string, o long")
    got = sorted(token_files.token_digests(d, PATH, PATTERN, order=[F.col("o")]).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(range(10), key=lambda k: (k * 7) % 10)


def test_a_damaged_table_is_refused(spark, tmp_path):
    folder = token_files.write_token_files(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), PATH, PATTERN, folder=f"{tmp_path}/out")
    from tabloom.llm import rans

    table = rans.Table(rans.quantise(np.arange(1000)))
    shard = next(n for n in os.listdir(folder) if n.endswith(".rtok"))
    with open(f"{folder}/{shard}", "rb") as f, pytest.raises(ValueError, match="another frequency table"):
        [*rans.read_documents(f, table)]
    data = bytearray(open(f"{folder}/{token_files.TABLE}", "rb").read())
    data[50] ^= 1
    with pytest.raises(ValueError):
        rans.read_table(bytes(data))


# 3 prefix counts


def test_steps_never_wrap():
    with pytest.raises(OverflowError):
        counter(PATH, PATTERN)._steps([1, 300])


# 4 top k


def test_whole_table_by_several_leaves(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = np.floor(64 * np.array([r["embedding"] for r in rows], float))
    assert kd_top_k.Tree(vectors, np.array([r["vec_id"] for r in rows])).leaves >= 5


def test_repeated_rows_and_copies(spark, monkeypatch):
    monkeypatch.setattr(kd_top_k, "LEAST_ROWS", 20)
    monkeypatch.setattr(kd_top_k, "SHARD_ROWS", 30)
    rnd = random.Random(2)
    rows = [(k, [float(rnd.randint(-5, 5)) for _ in range(4)]) for k in range(150)] + [(k, [5.0, 5.0, 5.0, 5.0]) for k in range(200, 320)] + [(3, [1.0, 2.0, 3.0, 4.0])] * 2 + [(40, [5.0, 0.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "id long, v array<double>").select("*", *[F.lit(1).alias(c) for c in ("cell", "shard", "kind", "floor", "rank")])
    asked = [(k, v) for k, v in rows if k % 20 == 0]
    got = sorted(map(tuple, kd_top_k.top_k(d, d.where("id % 20 = 0"), 20).collect()))
    want = []
    for q in {k for k, _ in asked}:
        scores = sorted((-int(np.dot(v, x)), k) for i, v in asked if i == q for k, x in rows if k != q)[:20]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scores)]
    assert got == sorted(want)


# 5 language


def test_out_of_place_distance_against_brute_force():
    rnd = random.Random(4)
    text = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5))) for _ in range(n))
    profiles = {}
    for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "fghiéß")):
        keys, counts = np.unique(rank_profiles.gram_keys(text(letters, 300)), return_counts=True)
        profiles[lang] = rank_profiles._ranked(keys, counts, 40)
    matcher = rank_profiles.Matcher(profiles, 40)
    for n in (1, 3, 30, 300):
        t = text("abcdefghiéß", n)
        grams = {}
        for run in t.lower().split():
            padded = f" {run} "
            for size in (1, 2, 3):
                for k in range(len(padded) - size + 1):
                    g = padded[k : k + size]
                    if g != " ":
                        key = 0
                        for c in g:
                            key = key << 21 | ord(c)
                        grams[key] = grams.get(key, 0) + 1
        # A blank between two runs is one: trigrams with a blank in the middle aren't counted, nor here.
        mine = sorted(grams, key=lambda g: (-grams[g], g))
        have, found = np.unique(rank_profiles.gram_keys(t), return_counts=True)
        shared = dict(zip(have.tolist(), found.tolist()))
        mine = sorted(shared, key=lambda g: (-shared[g], g))[:40]
        assert set(shared) == set(grams)
        apart = {lang: sum(abs(p.tolist().index(g) - k) if g in p.tolist() else 40 for k, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        lang, score = matcher.predict(t)
        assert lang == best and abs(score - (1 - apart[best] / (40 * len(mine)))) < 1e-12


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = words(3, 3_000) + " é日本 " * 50
    whole = rank_profiles.gram_counts(text)
    monkeypatch.setattr(rank_profiles, "CHARS", 997)
    assert all((a == b).all() for a, b in zip(whole, rank_profiles.gram_counts(text)))


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(rank_profiles, "LANGUAGES", 3)
    with pytest.raises(ValueError, match="more than 3 languages"):
        rank_profiles.learn_profiles(spark.createDataFrame([("a b", f"l{k}") for k in range(4)], "text string, lang string"))


# 6 decontamination


def test_windows_in_slabs(monkeypatch):
    items = [(k, words(k, 30, 200)) for k in range(4)]
    text = " ".join([words(50, 300, 200), items[1][1], words(51, 40, 200), items[3][1] * 1, items[3][1], words(52, 100, 200)])
    whole = simhash_decontam.Detector(items, 0.8).leaks(text)
    monkeypatch.setattr(simhash_decontam, "SLAB", 3)
    assert whole and simhash_decontam.Detector(items, 0.8).leaks(text) == whole


def test_long_words_are_found():
    """One changed long word: similarity by letters is above 0.8, and the fingerprint must not miss it."""
    rnd, found, near = random.Random(7), 0, 0
    for length, letters in ((120, 60), (150, 80)):
        for _ in range(150):
            item = [f"w{rnd.randrange(5000)}" for _ in range(length)]
            item[60] = "".join(rnd.choice("abcdefgh") for _ in range(letters))
            copy = list(item)
            copy[60] = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, letters)))
            if simhash_decontam.weighted_similarity(*(simhash_decontam.shingle_list(x) for x in (item, copy))) >= 0.8:
                near += 1
                found += bool(simhash_decontam.Detector([(1, " ".join(item))], 0.8).leaks(" ".join(copy)))
    print("near the threshold", near, "found", found)
    assert near > 20 and found == near


# 7 quality


def test_quality_held_out_on_a_third(spark):
    """About 1,000 labels to learn from."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    judged = site_quality.classify_quality(d, labels.where(~out)).select("row.doc_id", "kept").join(labels.where(out), "doc_id")
    kept = F.col("kept").cast("int")
    r = judged.select(F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), kept)).alias("good"), F.avg(F.when(F.col("toxic") == 1, kept)).alias("toxic"), F.avg(F.when(F.col("quality") == 0, kept)).alias("poor")).first()
    assert r["good"] > 0.97 and r["toxic"] < 0.03 and r["poor"] < 0.03


def nested(rows):
    """Strengths and means by the nested analysis of variance, written out over plain rows (host, path, p)."""
    n, mean = len(rows), np.mean([p for *_, p in rows])
    paths, hosts = {}, {}
    for h, q, p in rows:
        paths.setdefault((h, q), []).append(p)
        hosts.setdefault(h, []).append(p)
    within = max(sum(sum((p - np.mean(v)) ** 2 for p in v) for v in paths.values()) / max(n - len(paths), 1), 1e-9)
    ssp = sum(len(v) * (np.mean(v) - np.mean(hosts[h])) ** 2 for (h, _), v in paths.items())
    ssh = sum(len(v) * (np.mean(v) - mean) ** 2 for v in hosts.values())
    k1 = n - sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items())
    of_paths = max(0.0, ssp - (len(paths) - len(hosts)) * within) / k1 if k1 > 1e-9 * n else 0.0
    k2 = sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items()) - sum(len(v) ** 2 for v in paths.values()) / n
    k3 = n - sum(len(v) ** 2 for v in hosts.values()) / n
    of_hosts = max(0.0, ssh - (len(hosts) - 1) * within - of_paths * k2) / k3 if k3 > 1e-9 * n else 0.0
    weight = lambda x: max(5.0, min(1e6, within / x if x > 0 else 1e6))
    return mean, weight(of_paths), weight(of_hosts), paths, hosts


def test_site_posteriors_against_brute_force(spark):
    rnd = random.Random(9)
    rows = [(f"h{h}", f"h{h}/p{q}", min(1.0, max(0.0, 0.2 + 0.06 * h + 0.05 * q + rnd.gauss(0, 0.2)))) for h in range(8) for q in range(4) for _ in range(rnd.randint(1, 40))]
    got = site_quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()
    mean, of_path, of_host, paths, hosts = nested(rows)
    assert len(got) == len(paths)
    for r in got:
        assert r["path_n"] == len(paths[r["host"], r["path"]]) and abs(r["global_mean"] - mean) < 1e-9
        assert abs(r["path_strength"] / of_path - 1) < 1e-6 and abs(r["host_strength"] / of_host - 1) < 1e-6
        assert abs(r["host_mean"] - (sum(hosts[r["host"]]) + of_host * mean) / (len(hosts[r["host"]]) + of_host)) < 1e-9
    # Paths that are alike within their hosts say nothing of their own: a prior of any weight.
    alike = [(h, f"{h}/{q}", p) for h, ps in (("a", (0.1, 0.3)), ("b", (0.7, 0.9))) for q in range(6) for p in ps * 50]
    one = site_quality.site_posteriors(spark.createDataFrame(alike, "host string, path string, p double")).first()
    assert one["path_strength"] == site_quality.MOST_STRENGTH and one["host_strength"] == site_quality.LEAST_STRENGTH


def test_scores_against_brute_force(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for few in (20_000, 2):  # sites by broadcast and by a shuffle
        monkeypatch.setattr(site_quality, "BROADCAST_SITES", few)
        got = site_quality.classify_quality(d, labels).collect()
        assert len(got) == d.count()
        rows = [(r["host"], r["path"], r["doc_score"]) for r in got]
        mean, of_path, of_host, paths, hosts = nested(rows)
        log_odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
        for r in got:
            p, mine, site = r["doc_score"], paths[r["host"], r["path"]], hosts[r["host"]]
            of_site = (sum(site) - p + of_host * mean) / (len(site) - 1 + of_host)
            own = (sum(mine) - p + of_path * of_site) / (len(mine) - 1 + of_path)
            final = log_odds(p) + site_quality.SITE_WEIGHT * (log_odds(own) - log_odds(mean))
            assert abs(r["host_posterior"] - of_site) < 1e-6 and abs(r["path_posterior"] - own) < 1e-6
            assert abs(r["quality_score"] - 1 / (1 + math.exp(-final))) < 1e-6
            assert r["kept"] == (final >= -1e-8 and r["toxic_logit"] < site_quality.TOXIC_LOGIT)


def test_a_good_site_saves_a_doubtful_text(spark, monkeypatch):
    made = [("good", "good/x", 4.0, -9.0)] * 300 + [("bad", "bad/x", -4.0, -9.0)] * 300 + [("good", "good/x", -0.2, -9.0), ("bad", "bad/x", 0.2, -9.0), ("good", "good/x", 4.0, 0.0)]
    d = spark.createDataFrame([(k, *m) for k, m in enumerate(made)], "doc_id long, host string, path string, quality_logit double, toxic_logit double")
    p = 1 / (1 + F.exp(-F.col("quality_logit"))) * (1 - 1 / (1 + F.exp(-F.col("toxic_logit"))))
    monkeypatch.setattr(site_quality, "score_documents", lambda *_: d.withColumn("row", F.struct("doc_id")).withColumn("p", p))
    got = {r["doc_id"]: r["kept"] for r in site_quality.classify_quality(d, d, F.lit(""), F.lit("")).select("row.doc_id", "kept").collect()}
    assert got[0] and not got[300] and got[600] and not got[601] and not got[602]


# 8 near duplicates


def test_signatures_recall_at_the_border():
    """Pairs of similarity 0.8 to 0.85, made of real documents: all share a band and pass the signature test."""
    import duckdb

    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null order by doc_id").fetchall()]
    rnd, seen, banded, agreed = random.Random(3), 0, 0, 0
    for text in texts:
        parts = text.split()
        if not 60 <= len(parts) <= 2_000:
            continue
        for rate in (0.018, 0.021, 0.024):
            edited = " ".join(f"new{rnd.randrange(10**6)}" if rnd.random() < rate else w for w in parts)
            a, b = (min_max_dedup.shingles(t, 5) for t in (text, edited))
            common = len(np.intersect1d(a, b))
            if 0.80 <= common / (len(a) + len(b) - common) <= 0.85:
                x, y = min_max_dedup.signature(a), min_max_dedup.signature(b)
                seen += 1
                banded += bool((min_max_dedup.band_keys(x) == min_max_dedup.band_keys(y)).any())
                agreed += int((x.astype(np.uint8) == y.astype(np.uint8)).sum() >= min_max_dedup.AGREE)
    print("pairs", seen, "share a band", banded, "agree", agreed)
    assert seen > 300 and banded == agreed == seen


def test_the_exact_switch_and_hot_keys(spark, monkeypatch):
    from tabloom.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 20)
    monkeypatch.setattr(min_max_dedup, "join_hot", lambda *a: join_hot(*a, least=5))
    base = words(1, 80).split()
    texts = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(0, 80, 3)] + [" ".join(base)] * 40 + [" ".join(base[:k] + words(k, 8).split() + base[k + 8 :]) for k in range(0, 70, 2)] + [words(100 + k, 30) for k in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    for agree in (min_max_dedup.AGREE, 0):
        got = {r["doc_id"]: r["component_id"] for r in min_max_dedup.near_duplicates(d, agree=agree).collect()}
        assert got == {k: find(k) for k in range(len(texts))}


# 9 archives


def test_index_lines_are_cdxj():
    urls = ["http://www.Example.com/b?x=1", "https://a.example.com:8080/", "not a url", "", "http://[bad", "http://example.com/a b"]
    records = [(k, warc_zip.warc_record(k, u, b"p" * 150, "0" * 64, 3 if k == 2 else None)) for k, u in enumerate(urls)]
    data = b"".join(warc_zip.archive_bytes(iter(records)))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        lines = z.read(warc_zip.INDEX).decode().splitlines()
    assert lines == sorted(lines) and len(lines) == len(urls)
    parsed = [line.split(" ", 2) for line in lines]
    assert all(len(key) and stamp == "20240101000000" for key, stamp, _ in parsed)
    entries = {json.loads(e)["url"]: (key, json.loads(e)) for key, _, e in parsed}
    assert entries["http://www.Example.com/b?x=1"][0] == "com,example)/b?x=1" and entries["https://a.example.com:8080/"][0] == "com,example,a:8080)/"
    assert {e["mime"] for _, e in entries.values()} == {"text/html", "warc/revisit"} and all({"offset", "length", "filename", "digest", "status"} <= e.keys() for _, e in entries.values())
    assert len([*warc_zip.Archive(io.BytesIO(data)).records()]) == len(urls)


def test_an_archive_of_several_warcs():
    out, lines = io.BytesIO(), []
    with zipfile.ZipFile(out, "w") as z:
        for name in ("one.warc.gz", "two.warc.gz"):
            packed = b""
            for k in range(3):
                one = gzip.compress(warc_zip.warc_record(k, f"http://{name}/{k}", name.encode(), "0" * 64, None))
                lines.append(f'com,{name})/{k} 20240101000000 {json.dumps({"filename": name, "offset": len(packed), "length": len(one)})}')
                packed += one
            z.writestr(f"archive/{name}", packed)
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(["!meta {}", *lines]).encode()))
        z.writestr("pages/pages.jsonl", "{}")
    got = [*warc_zip.Archive(out).records()]
    assert sorted(r["payload"] for r in got) == [b"one.warc.gz"] * 3 + [b"two.warc.gz"] * 3
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("indexes/more.cdxj", 'x 1 {"filename": "three.warc.gz", "offset": 0, "length": 5}')
    with pytest.raises(warc_zip.ArchiveError, match="three.warc.gz"):
        [*warc_zip.Archive(out).records()]


def test_archives_are_cut_at_their_size(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "ARCHIVE_ROWS", 7)
    rows = [(k, f"http://h/{k}", ("y" * 150 if k % 3 else None)) for k in range(100)] + [(None, "u", "y" * 150)] * 5 + [(4, "again", "y" * 150)]
    folder, manifest = warc_zip.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    made = manifest.collect()
    assert sum(r["records"] for r in made) == len(rows) and max(r["records"] for r in made) == 7
    got = [x for r in made for x in warc_zip.read_archive(f"{folder}/{r['file']}".removeprefix("file://"))]
    assert len(got) == len(rows)
    assert {r[0] for r in got if r[3] == "response" and r[1] == 150} == {1} and all(r[4] == 1 for r in got if r[3] == "revisit")


# 10 mixing


def brute_mix(rows, schedules, total_share, most):
    """Copies and positions of rows (doc_id, size, source, h, h2), from the docstring."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: curriculum_mix.integral(schedules[k % len(schedules)]) for k, s in enumerate(names)}
    size = {s: sum(r[1] for r in by[s]) for s in names}
    target, open_ = {}, set(names)
    total = total_share * sum(size.values())
    while open_:
        rest, w = total - sum(target.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if rest * weights[s] / w >= most * size[s]]
        for s in over or open_:
            target[s] = most * size[s] if over else rest * weights[s] / w
        open_ -= set(over) if over else open_
    out = {}
    for k, s in enumerate(names):
        knots, mine = schedules[k % len(schedules)], by[s]
        buckets = min(math.ceil(math.sqrt(len(mine))), math.ceil(len(mine) / 256))
        mine = sorted(mine, key=lambda r: (r[3] % buckets, r[3], r[4]))
        full = int(target[s] / max(size[s], 1) + 1e-12)
        rest = max(target[s] - full * size[s], 0.0) if full < most else 0.0
        extra, able, taken = {}, 0, 0
        for n, r in enumerate(mine):
            if 0 < r[1] <= rest:
                if able + r[1] <= rest:
                    extra[n] = able
                    taken += r[1]
                able += r[1]
        for big in sorted({r[1] for n, r in enumerate(mine) if n not in extra and 0 < r[1] <= rest}, reverse=True):
            for n, r in enumerate(mine):
                if r[1] == big and n not in extra and taken + big <= rest:
                    extra[n] = taken
                    taken += big
        start = 0
        for n, r in enumerate(mine):
            places = [c * size[s] + start + r[1] / 2 for c in range(full)]
            if n in extra:
                places.append(full * size[s] + extra[n] + r[1] / 2)
            out[r[0]] = [solve(knots, min(p / max(target[s], 1e-9), 1.0)) for p in places]
            start += r[1]
    return out


def solve(knots, share):
    """The time at which the schedule's integral reaches the share, by halving."""
    whole = curriculum_mix.integral(knots)

    def reached(t):
        done = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            x = min(max(t - t0, 0.0), t1 - t0)
            done += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return done / whole

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) < share else (low, middle)
    return high


@pytest.mark.parametrize("few", [20_000, 1])
def test_positions_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(curriculum_mix, "BROADCAST_SOURCES", few)
    rnd = random.Random(12)
    rows = [(k, " ".join(["w"] * rnd.randint(0, 60)), None if k % 9 == 0 else f"s{rnd.choice('aabbbcdé')}") for k in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = d.select("doc_id", curriculum_mix.word_count().alias("size"), "source", F.xxhash64(F.lit(42), F.col("doc_id").cast("string")).alias("h"), F.xxhash64(F.lit(42), "text").alias("h2"))
    want = brute_mix([tuple(r) for r in keyed.collect()], curriculum_mix.SCHEDULES, 1.5, 2.0)
    for carry in (["doc_id"], ["doc_id", "text"]):
        got = {r["doc_id"]: r["p"] for r in curriculum_mix.curriculum_mix(d, carry=carry).select("doc_id", F.col("mix.positions").alias("p")).collect()}
        assert got.keys() == want.keys()
        for k, p in want.items():
            assert len(got[k]) == len(p) and all(abs(x - y) < 1e-6 for x, y in zip(got[k], p)), k
    order = [r["doc_id"] for r in curriculum_mix.mixture(d).collect()]
    place = {(k, n): p for k, ps in want.items() for n, p in enumerate(ps)}
    times, met = [], {}
    for k in order:
        times.append(place[k, met.setdefault(k, 0)])
        met[k] += 1
    assert len(times) == len(place) and all(a <= b + 1e-6 for a, b in zip(times, times[1:]))


# The pipeline


def tables(spark, folder, docs, labels=(), benchmark=()):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d = d.select("*", *[F.lit(1).alias(c) for c in ("row", "host", "path", "word", "position", "copies", "file__", "o0", "ids", "mix")])
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    item = words(77, 20)
    docs = [(A, words(1, 50), "en", "s1", 1), (None, words(2, 50), "en", None, 1), (B, words(3, 50), "en", "s1", 1), (None, None, None, None, None), (5, "", "en", "s2", 0), (6, words(6, 50), "en", "s2", 1), (6, words(6, 50), "en", "s2", 1), (7, words(6, 50), "en", "s2", 1), (8, f"{words(8, 30)} {item} {words(9, 30)}", "en", "s1", 1)]
    tables(spark, tmp_path, docs, benchmark=[(1, item)])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    # 7 is a copy of 6, 8 holds the item; s1 has the largest weight, and its documents are taken as they are.
    assert {A, B} <= ids <= {A, B, 5, 6, None}
    assert len({r["start"] for r in got}) == len(got)


def test_pipeline_keeps_the_order_of_the_mix(spark, tmp_path):
    import corpus_pipeline

    spark.conf.set(corpus_pipeline.TOKENS_DIR, f"{tmp_path}/tokens")
    try:
        docs = [(k, words(k, 20 + k % 30), "en", f"s{k % 3}", 1) for k in range(120)]
        tables(spark, tmp_path, docs)
        mixed = cut(curriculum_mix.mixture(spark.read.parquet(f"{tmp_path}/documents.parquet")), "mixed")
        got = corpus_pipeline.token_output(spark, mixed, str(tmp_path)).collect()
        want = [r["doc_id"] for r in curriculum_mix.mixture(spark.read.parquet(f"{tmp_path}/documents.parquet")).select("doc_id").collect()]
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == want and want != sorted(want)
        (run,) = os.listdir(f"{tmp_path}/tokens")
        again = token_files.read_token_files(spark, f"{tmp_path}/tokens/{run}").orderBy("start").collect()
        assert [r["doc_id"] for r in again] == want
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in again)
    finally:
        spark.conf.unset(corpus_pipeline.TOKENS_DIR)


# Chunks of many texts at once


def test_many_texts_at_once():
    import pyarrow as pa

    from test_operators import oddities

    texts = [None, "", *oddities(), "a b c " * 50 + "end", "one", "x\ny z", "tail ", "　x", "x\x85y", *[words(k, 40) for k in range(30)]]
    e, c = encoder(PATH, PATTERN), counter(PATH, PATTERN)
    for k in (0, 7):
        column = pa.array(texts, pa.string()).slice(k)
        assert e.encode_all(column).to_pylist() == [e.encode(t) for t in texts[k:]]
        assert c.tables(column).to_pylist() == [c.table(t) for t in texts[k:]]
    assert e.encode_all(pa.array([], pa.string())).to_pylist() == [] == c.tables(pa.array([None], pa.string()).slice(1)).to_pylist()
