"""Training-data operators against brute force, exact round trips and held-out cases."""

import random
from collections import Counter
from itertools import combinations
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import cooccur, leak, packing, quantiles, sentences


# ------------------------------------------------------------------------------------------------ stripes


def test_pairs_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), [rng.choice([None, *range(8)]) for _ in range(rng.randrange(6))] if rng.random() > 0.05 else None) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, i array<int>").withColumn("item", F.lit("clash"))
    n, one, two = Counter(), Counter(), Counter()
    for g, i in rows:
        if g is None or i is None:
            continue
        s = sorted({x for x in i if x is not None})
        n[g] += 1
        one.update((g, x) for x in s)
        two.update((g, *p) for p in combinations(s, 2))
    cut_up = cooccur.cooccurrence(df, "g", "i", wide=3)
    got = cooccur.cooccurrence(df, "g", "i").collect()
    assert sorted(map(str, cut_up.collect())) == sorted(map(str, got))
    assert cooccur.cooccurrence(df, "g", "i", least=2.71).count() == sum(r.llr >= 2.71 for r in got)
    assert {(r.grp, r.item_a, r.item_b): (r.both, r.n_a, r.n_b, r.records) for r in got} == {k: (x, one[k[0], k[1]], one[k[0], k[2]], n[k[0]]) for k, x in two.items()}
    r = got[0]
    e = lambda o, p: 0 if o == 0 else o * log(o / p)
    cells = [(r.both, r.n_a * r.n_b), (r.n_a - r.both, r.n_a * (r.records - r.n_b)), (r.n_b - r.both, r.n_b * (r.records - r.n_a)), (r.records - r.n_a - r.n_b + r.both, (r.records - r.n_a) * (r.records - r.n_b))]
    assert abs(r.llr - 2 * sum(e(o, p / r.records) for o, p in cells)) < 1e-6


def test_stripes_are_flushed_and_merged_in_any_order():
    rng = random.Random(2)
    rows = [(rng.choice("ab"), sorted(rng.sample(range(9), rng.randrange(9)))) for _ in range(120)]
    want = Counter((g, i, j) for g, s in rows for k, i in enumerate(s) for j in s[k:]) + Counter((g, -1, -1) for g, _ in rows)
    batches = [pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows[k : k + 50]]), pa.array([s for _, s in rows[k : k + 50]], pa.list_(pa.int64()))], names=["grp", "items"]) for k in (0, 50, 100)]
    for most, pairs in ((7, 5), (500_000, 2_000_000)):
        made = pa.Table.from_batches(list(cooccur._stripes(iter(batches), most, pairs))).sort_by([("grp", "ascending"), ("item", "ascending")])
        merged = list(cooccur._merge(iter(made.to_batches(max_chunksize=3)), most))
        got = [(g, i, j, n) for b in merged for g, i, js, ns in zip(*(c.to_pylist() for c in b.columns)) for j, n in zip(js, ns)]
        assert len(got) == len(want) and {x[:3]: x[3] for x in got} == dict(want)


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([("a", []), ("a", [3, 3])], "g string, i array<int>")
    assert cooccur.cooccurrence(df, "g", "i").count() == 0
    assert cooccur.cooccurrence(df.limit(0), "g", "i").count() == 0


# ---------------------------------------------------------------------------------------------- percentiles


def rank_off(values, q, f):
    s = np.sort(values)
    lo, hi = np.searchsorted(s, q, "left") / len(s), np.searchsorted(s, q, "right") / len(s)
    return max(lo - f, f - hi, 0)


def test_states_keep_their_bound():
    rng = np.random.default_rng(2)
    for values in (rng.lognormal(size=200_000), np.r_[np.zeros(150_000), rng.normal(size=60_000)], np.arange(100_000.0)):
        parts = []
        for chunk in np.array_split(values, 23):
            s = quantiles.State(64)
            s.add(chunk)
            parts += list(s.buffers())
        whole = quantiles._folded(parts, 64)
        f = np.array([0.01, 0.25, 0.5, 0.9, 0.99])
        n, err, q = quantiles.read([b[1:] for b in whole.buffers()], f)
        assert n == len(values) and err / n < 0.08
        assert max(rank_off(values, x, y) for x, y in zip(q, f)) <= err / n + 1e-9


def test_percentiles_in_spark(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=6000)
    rows = [(k, "big" if k % 3 else "small" if k % 30 == 0 else None, float(v[k]) if k % 50 else float("nan"), k % 7) for k in range(6000)] + [(-1, "none", -9999.0, 1), (-2, "none", None, 1)]
    df = spark.createDataFrame(rows, "id int, g string, x double, d int").withColumns({"key": F.lit("clash"), "part": F.lit(9)})
    found = {}
    for parts in (1, 5):
        st = quantiles.sketch(df.repartition(parts), {"g": "g", "day": F.col("d")}, ["x"], row=["id"], buckets=8, absent=-9999.0)
        found[parts] = quantiles.percentiles(st.repartition(parts + 2), [0.1, 0.5], 8)
    got = {(r["by"], r["key"]): r for r in found[1].collect()}
    assert got == {(r["by"], r["key"]): r for r in found[5].collect()}  # whatever the partitions
    assert ("g", "none") not in got and set(k for b, k in got if b == "day") == {str(i) for i in range(7)}
    for g in ("big", "small"):
        own = np.array([x for _, a, x, _ in rows if a == g and x == x])
        r = got["g", g]
        assert r.n == len(own) and rank_off(own, r.q50, 0.5) <= r.rank_error + 1e-9
        if g == "small":
            assert r.rank_error == 0 and abs(r.q50 - np.quantile(own, 0.5)) < 1e-12
    values = df.filter("g is not null and x is not null and not isnan(x) and x <> -9999").select(F.lit("g").alias("by"), F.col("g").alias("key"), F.lit("x").alias("metric"), F.col("x").alias("value"))
    assert {r["key"]: r.within for r in quantiles.within_bounds(values, found[1], [0.1, 0.5]).collect()} == {"big": True, "small": True}
    off = found[1].withColumn("q50", F.col("q50") + 0.5)
    assert not any(r.within for r in quantiles.within_bounds(values, off, [0.1, 0.5]).collect())
    assert quantiles.percentiles(quantiles.sketch(df.limit(0), {"g": "g"}, ["x"], row=["id"]), [0.5]).count() == 0


def test_states_merge_along_a_tree(spark, monkeypatch):
    df = spark.range(30_000).select("id", F.lit("k").alias("g"), F.sin("id").alias("x"))
    st = quantiles.sketch(df, {"g": "g"}, ["x"], row=["id"], buckets=64, size=64).repartition(3)
    monkeypatch.setattr(quantiles, "TREE", 4)
    r = quantiles.percentiles(st, [0.5], 64).first()
    own = np.sin(np.arange(30_000))
    assert r.n == 30_000 and rank_off(own, r.q50, 0.5) <= r.rank_error < 0.2
    assert quantiles.buckets_for(1) == quantiles.buckets_for(quantiles.BUCKET_ROWS) == 1 and quantiles.buckets_for(5 * quantiles.BUCKET_ROWS) == 8


def test_states_combine_over_days(spark):
    df = spark.range(20_000).select("id", F.lit("k").alias("g"), (F.col("id") % 10).alias("day"), F.rand(4).alias("x"))
    days = [quantiles.sketch(df.filter(F.col("day") == d), {"g": "g"}, ["x"], row=["id"]) for d in range(10)]
    all_days = days[0]
    for d in days[1:]:
        all_days = all_days.unionByName(d)
    r = quantiles.percentiles(quantiles.combine(all_days), [0.5]).first()
    assert r.n == 20_000 and abs(r.q50 - 0.5) < r.rank_error + 0.02 and r.rank_error < 0.03


def test_measured_tables(spark):
    rows = [("f", 1000, [100.0, 0.0, 50.0, None], [1.0, -1.0, 0.0, 9.0]), ("f", 3000, [0.0, 0.5, 1.0], [-1.0, 0.0, float("nan")]), ("g", None, [], []), ("h", 5, None, None)]
    t = spark.createDataFrame(rows, "family string, samples long, quantile_pcts array<double>, quantile_vals array<double>")
    got = {r["key"]: r for r in quantiles.percentiles(quantiles.table_states(t), [0.25, 0.5]).collect()}
    assert set(got) == {"f"} and got["f"].n == 4000 and abs(got["f"].q25 + 0.5) < 0.02


# -------------------------------------------------------------------------------------------------- packing


def test_packing_holds(spark):
    rng = random.Random(5)
    texts = ["", None, "word " * 9000, *[" ".join(str(rng.randrange(999)) for _ in range(rng.randrange(1, 400))) for _ in range(300)]]
    rows = [(k % 250, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    out = packing.pack(df, capacity=512).collect()
    sizes = Counter()
    for r in out:
        sizes[r.container_id] += r.n_tokens
    assert max(sizes.values()) <= 512
    enc = packing.encoding(packing.TOKENIZER, packing.PATTERN)
    want, got = Counter(), Counter()
    for d, t in rows:
        want[d] += len(enc.encode_ordinary(t or ""))
    for r in out:
        got[r.doc_id] += r.n_tokens
    assert got == want and len({r.doc_id for r in out}) == 250
    whole = [r for r in out if r.piece_no == 0]
    assert len(whole) == len(rows)
    assert sum(want.values()) / (512 * len(sizes)) > 0.97
    assert packing.pack(df.limit(0)).count() == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(7)
    s = np.sort(rng.integers(1, 900, 4000))[::-1]
    a = packing.assign(s, 2048)
    room, cost = np.bincount(a, s), np.bincount(a, s + packing.QUADRATIC * s * s)
    assert room.max() <= 2048 and s.sum() / (2048 * len(room)) > 0.98 and cost[room > 1900].std() / cost.mean() < 0.1


# ------------------------------------------------------------------------------------------------------ leak


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, 60))) for k in range(12)]
    docs, want = [], set()
    for d in range(200):
        k = rng.randrange(12)
        w = items[k][1].split()
        n = rng.choice([0, 12, 15, 16, 19, 24, 40])
        a = rng.randrange(0, 60 - n + 1)
        part = w[a : a + n]
        hits = set()
        if n >= 19 and rng.random() < 0.7:
            hits.add(rng.randrange(1, n - 1))
        if n == 40 and rng.random() < 0.5:
            hits = set(range(4, 40, 8))
        part = ["altered" if i in hits else x for i, x in enumerate(part)]
        best = max((sum(1 for i in range(s, s + 18) if i not in hits) for s in range(0, n - 17)), default=0)
        near = n == 16  # 16 words and one altered at either end are 17: not enough
        if best >= 17 and not near:
            want.add((d, k))
        noise = rng.choice(["{}", "<b>{}</b>", "{}​", "*{}*,", "{}\n"])
        part = [noise.format(x).upper() if rng.random() < 0.3 else noise.format(x) for x in part]
        docs.append((d, " ".join([*words(rng, 30), *part, *words(rng, 30)])))
    docs += [(900, None), (901, ""), (902, items[3][1] * 200)]
    want.add((902, 3))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame([*items, (77, None), (78, "short"), (79, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leak.leaks(df, it).collect()} == want
    assert leak.leaks(df.limit(0), it).count() == 0 and leak.leaks(df, it.limit(0)).count() == 0


def test_leak_radius():
    """One altered word leaves one block of a window's fingerprint equal and may move many bits of the other, and the
    weighted similarity keeps every such window."""
    rng = random.Random(12)
    text = words(rng, 40)
    index = leak.Index([(1, " ".join(text)), (2, " ".join(words(rng, 40))), (3, " ".join(text[:20]))])
    own = leak.blocks(text, False)
    moved = []
    for _ in range(300):
        a, k = rng.randrange(40 - 18 + 1), rng.randrange(18)
        doc = [*words(rng, 7), *text[a : a + 18], *words(rng, 7)]
        doc[7 + k] = words(rng, 1)[0]
        b = leak.blocks(doc, False)
        apart = [bin(int(b[7 + h]) ^ int(own[a + h])).count("1") for h in (0, 9)]
        assert min(apart) == 0
        moved.append(max(apart))
        assert leak.held_items(" ".join(doc), index)[1] == 18
    assert max(moved) > 5
    # equal words in another order share a block, not the shingles
    assert leak.held_items(" ".join(sorted(text[:9]) + text[9:17]), index) == {}


def test_leaks_in_blocks(spark, monkeypatch):
    rng = random.Random(10)
    items = [(k, " ".join(words(rng, 30))) for k in range(9)]
    it = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(k, t) for k, t in items], "doc_id long, text string")
    monkeypatch.setattr(leak, "BLOCK_ITEMS", 2)
    assert {(r.doc_id, r.item_id) for r in leak.leaks(df, it).collect()} == {(k, k) for k in range(9)}


def test_leaks_in_dense_script():
    rng = random.Random(11)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(80))
    ix = leak.Index([(1, text)])
    assert leak.held_items("前" + text[10:46], ix) == {1: 36} or leak.held_items("前" + text[10:46], ix)[1] >= 36
    assert leak.held_items(text[10:44], ix) == {}
    assert 1 in leak.held_items(text[5:25] + "錯" + text[26:50], ix)


def test_one_altered_word_moves_one_block():
    rng = random.Random(12)
    w = words(rng, 18)
    a = leak.blocks(w, False)
    for k in range(18):
        b = leak.blocks([*w[:k], "other", *w[k + 1 :]], False)
        assert a[0] == b[0] or a[9] == b[9]


# -------------------------------------------------------------------------------------------------- sentences

PLAIN = ["Dr. Miller came late.", "The {n} river rose.", "Was it deep?", "Nobody knew.", "Dr. Haden left at 3.5 km.", "See Fig. {n} for it.", "He said: \"Go home. Now.\"", "\"Is it {n}?\" asked the team.", "Stop!"]
DENSE = ["湖面很平静。", "他说“走吧。”然后离开了。", "版本{n}坏了！", "为什么？"]


def test_sentences(spark):
    rng = random.Random(21)
    rows, want = [(5001, None), (5002, ""), (5003, " \n \n"), (5004, "no mark at all\nwrapped here")], {5004: ["no mark at all\nwrapped here"]}
    for k in range(1500):
        parts, units = [], []
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.15:
                items = [f"{m} {rng.choice(PLAIN)} {rng.choice(PLAIN)}".replace("{n}", str(k)) for m in rng.choice([("-", "-"), ("1.", "2.")])]
                parts.append("\n".join(items))
                units += items
                continue
            dense = k % 5 == 4
            own = [rng.choice(DENSE if dense else PLAIN).replace("{n}", str(k)) for _ in range(rng.randrange(1, 5))]
            parts.append(("" if dense else rng.choice([" ", "  ", "\n"])).join(own))
            units += own
        rows.append((k, "\n\n".join(parts)))
        want[k] = units
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("end_pos", F.lit("clash"))
    got = {}
    for r in sentences.split(df).collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    text = dict(rows)
    for k, units in want.items():
        assert [text[k][a:b] for a, b in sorted(got[k])] == units
    assert not {5001, 5002, 5003} & set(got)
    for k, t in rows:
        if t and t.strip():
            spans = sorted(got[k])
            assert "".join("".join(t[a:b] for a, b in spans).split()) == "".join(t.split())


def test_no_documents(spark):
    assert sentences.split(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_without_end():
    m = sentences.Model([np.full(z, 0.5, np.float32) for z in sentences.SIZES], [np.zeros(z, np.float32) for z in sentences.SIZES], 0.5, True)
    t = "word " * 200_000
    _, start, end = sentences.units(sentences.Packed.read(sentences.pack([(1, t)])), m)
    assert list(zip(start, end)) == [(0, len(t) - 1)]


def test_heading_lines_and_line_ends():
    assert len(sentences.blocks("# a \n" * 5000)) == 5000
    assert [(a, b) for a, b, _ in sentences.blocks("# Title\r\nSome text\r\n\r\n* one\r\n* two")] == [(0, 7), (9, 18), (22, 27), (29, 34)]


def test_arrow_types():
    assert pa.types.is_list(dict(quantiles._TYPES)["vals"])


def test_units_cover_texts(spark):
    docs = spark.createDataFrame([(1, "One. Two here.\n\n* a\n* b"), (2, "  "), (3, None), (4, "Nothing ends"), (4, "Nothing ends")], "doc_id long, text string").withColumn("start_pos", F.lit("clash"))
    found = sentences.split(docs)
    assert {r.doc_id: r.sound for r in sentences.covered(docs, found).collect()} == {1: True, 4: True}
    assert {r.doc_id: r.sound for r in sentences.covered(docs, found.filter("doc_id = 1 and start_pos > 0")).collect()} == {1: False, 4: False}
    assert sentences.covered(docs.limit(0), found).count() == 0
