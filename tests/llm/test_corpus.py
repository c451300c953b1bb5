"""Corpus operators against brute force, round trips and held-out accuracy on small fixtures."""

import hashlib
import os
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerolake.llm import bpe, common, decontaminate, jaccard_join, langid, quality_model, quality_rules, suffix_dedup, surrogates, token_counts, training_order

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, block string, n_tokens int"
ODD = [None, "", " ", "  a  b ", "a ", "▁x ▁", "ab" * 700, "é" * 300 + "x", "Hello, WORLD's 12 <|endoftext|>x é…\n ok", "ΑΣ Σ<|startoftext|>'ll're", "中文 \x1c a\x85b\xa0c ½", "x" * 5000, "one two three", "one two three", "z" * 399, "z" * 399]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(10_000 + i, t, None) for i, t in enumerate(ODD)] + rows[:2]
    rows += [(20_000, rows[5][1] + " tail", "en"), (None, "no id", "en")]
    return spark.createDataFrame([(i, t, x, None, None, "clash", "clash", 1) for i, t, x in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_token_counts(docs, empty):
    sp = token_counts.Pieces(token_counts.MODEL).sp
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs).collect())
    assert got == Counter((i, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for i, t in texts(docs))
    assert token_counts.count_tokens(empty).count() == 0


def test_bpe(docs, empty):
    lib = Tokenizer.from_file(token_counts.model_path(bpe.MODEL))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t in texts(docs):
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.encode_decode(docs).collect()) == want
    assert bpe.encode_decode(empty).count() == 0
    whole = bpe.encode_decode(docs, outputs=("decoded", "ids")).collect()
    assert Counter((r["doc_id"], r["n_tokens"], sha(" ".join(map(str, r["ids"]))), sha(r["decoded"])) for r in whole) == want


def long_words():
    rng = np.random.default_rng(4)
    a, b = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 4096)), "a" * 4096
    return [a + b, b + a, f"{a}{b} {b}{a}", "中文字" * 3000 + " q", "é" * 70_000, "ab " * 300_000, a * 200, None, ""]


def test_long_words_and_very_long_texts():
    texts = pa.array(long_words(), pa.large_string())
    lib, own = Tokenizer.from_file(token_counts.model_path(bpe.MODEL)), bpe.WordBPE(bpe.MODEL)
    ids, at = own.encode_block(texts)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == [lib.encode(t or "", add_special_tokens=False).ids for t in long_words()]
    pieces = token_counts.Pieces(token_counts.MODEL, keep_ids=True)
    want = [pieces.sp.encode(t or "") for t in long_words()]
    ids, at = pieces.stream(texts, 2)
    assert [ids[i : j - 1].tolist() for i, j in zip(at, at[1:], strict=False)] == want
    assert token_counts.Pieces(token_counts.MODEL).counts(texts).tolist() == list(map(len, want))


def test_hashes_part_runs_that_swap_far_bytes():
    a = np.tile(np.arange(256, dtype=np.uint8), 1000)
    b = a.copy()
    for k in (1, 4096, 65_536, 131_072):
        b[:] = a
        b[7], b[7 + k + (k % 256 == 0)] = a[7 + k + (k % 256 == 0)], a[7]
        raw, starts = np.concatenate([a, b]), np.array([0, len(a)])
        for h in common.hash_pairs(raw, starts, np.ones(len(raw), bool)):
            assert h[0] != h[1]


def test_hash_table_tells_pairs_apart():
    table, rng = common.HashTable(500), np.random.default_rng(6)
    keys, checks = np.repeat(rng.integers(1, 2**63, 100).astype(np.uint64), 5), np.tile(np.arange(1, 6, dtype=np.uint64), 100)
    table.add(keys, checks)
    assert table.find(keys, checks).tolist() != [-1] * 500 and sorted(table.find(keys, checks)) == list(range(500))
    assert (table.find(keys, checks + np.uint64(9)) == -1).all()
    assert set(zip(*(x.tolist() for x in table.all()), strict=True)) == set(zip(keys.tolist(), checks.tolist(), strict=True))


def test_names_of_any_size_have_their_own_hashes():
    """Size, flag and every byte count, zeros as well, wherever the name lies."""
    raw = np.concatenate([np.zeros(200, np.uint8), np.random.default_rng(8).integers(0, 256, 400).astype(np.uint8)])
    names = [(at, size, flag) for at in (0, 200, 201, 400) for size in (*range(20), 63, 64, 65, 128, 200) for flag in (False, True)]
    for k in (0, 7, 8, 15, 63, 64, 120):
        raw[400:600] = raw[200:400]
        raw[400 + k] ^= 1
        keys = list(zip(*(x.tolist() for x in common.name_pairs(raw, *map(np.array, zip(*names, strict=True)))), strict=True))
        for h in zip(*keys, strict=True):
            assert 0 not in h and len(set(h)) == len({(raw[a : a + n].tobytes(), f) for a, n, f in names})
        moved = common.name_pairs(np.concatenate([raw[:3], raw]), *map(np.array, zip(*((a + 3, n, f) for a, n, f in names), strict=True)))
        assert keys == list(zip(*(x.tolist() for x in moved), strict=True))


def test_words_are_encoded_once_whatever_stands_beside_them():
    p = token_counts.Pieces(token_counts.MODEL, keep_ids=True)
    encoded, encode = [], p.encode
    p.encode = lambda names: encoded.extend(names) or encode(names)
    own = pa.array(["loser größer", "loser, größer.\nloser", " loser) größer)) (loser"], pa.large_string())
    ids, at = p.stream(own, 2)
    assert [ids[i : j - 1].tolist() for i, j in zip(at, at[1:], strict=False)] == [p.sp.encode(t) for t in own.to_pylist()]
    assert sorted(x for x in encoded if "größer" in x) == ["größer"] and len([x for x in encoded if "loser" in x]) == 3


def test_cuts_between_kinds_are_the_librarys():
    """Random texts of parts that pieces join (quotes and full stops, spaces and brackets) or can't join."""
    p, rng = token_counts.Pieces(token_counts.MODEL, keep_ids=True), np.random.default_rng(9)
    parts = [*"ab.,\n\t0’”»²—ÄßœĿſƀΩж中é\u0301\u00ad\x00\x1f\x7f😀▁<", " ", "  ", "   ", "the", "s", "ing", "&&", "...", "</s>", "<0x0A>", "’,", "”.", " (", "don't", "20", "×÷", "a" * 70, "." * 70]
    own = [None, "", *parts, *("".join(rng.choice(parts, n)) for n in rng.integers(1, 40, 3000))]
    texts = pa.array(own, pa.large_string())
    want = [p.sp.encode(t or "") for t in own]
    for _ in range(2):
        ids, at = p.stream(texts, 2)
        assert [ids[i : j - 1].tolist() for i, j in zip(at, at[1:], strict=False)] == want
        assert p.counts(texts).tolist() == list(map(len, want))
    p.may_cut = token_counts._AT_SPACES
    p.reset()
    assert p.counts(texts).tolist() == list(map(len, want))


@pytest.mark.parametrize("cache", [5, 1000])
def test_one_cache_serves_counts_and_ids(cache):
    """A pass for ids after one for counts encodes nothing again, unless the cache was full; results are the library's anyway."""
    p = token_counts.Pieces(token_counts.MODEL, keep_ids=True, cache=cache)
    own = pa.array([*ODD, "ñandú  größer\nx " * 3, "one two   three "], pa.large_string())
    want, encoded, encode = [p.sp.encode(t or "") for t in own.to_pylist()], [], p.encode
    p.encode = lambda names: encoded.extend(names) or encode(names)
    assert p.counts(own).tolist() == [len(x) for x in want] and len(encoded) > 20
    first = len(encoded)
    ids, at = p.stream(own, 2)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == [[*x, 2] for x in want]
    assert (len(encoded) == first) == (cache == 1000)


def test_second_pass_encodes_nothing_again(docs, monkeypatch):
    """The pass that writes tokens finds the pre-tokens of the counting pass in the worker's cache."""
    encoded, encode = [], token_counts.Pieces.encode
    monkeypatch.setattr(token_counts.Pieces, "encode", lambda self, names: encoded.extend(names) or encode(self, names))
    monkeypatch.setattr(training_order, "_workers", {})
    monkeypatch.setattr(training_order.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(training_order.common, "map_batches", lambda rows, work, schema: work)
    own = [t for _, t in texts(docs)]
    batch = pa.record_batch([pa.array(range(len(own))), pa.array(own), pa.array(["f"] * len(own)), pa.array(range(len(own)))], ["doc_id", "text", "file", "row"])
    counted = pa.Table.from_batches(training_order.sequences(docs, False)(iter([batch])))
    first = len(encoded)
    written = pa.Table.from_batches(training_order.sequences(docs, True)(iter([batch])))
    assert len(encoded) == first > 0
    assert [len(t) // 2 for t in written["tokens"].to_pylist()] == counted["n_tokens"].to_pylist() and counted["local"].to_pylist() == written["local"].to_pylist() == list(range(len(written)))


def test_a_workers_cache_lasts_from_task_to_task(spark):
    """Tasks that a worker runs one after the other, of either pass, meet one cache."""
    common.ship(spark)
    rows = spark.range(0, 4, 1, 1).selectExpr("id AS doc_id", "'a b' AS text", "'f' AS file", "id AS row")
    for tokens in (False, True):
        assert training_order.sequences(rows, tokens).count() == 4

    def held(batches):
        from aerolake.llm import training_order as module

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([sum(p.table.used for p in module._workers.values())])], ["pid", "n"])

    found = {r["pid"]: r["n"] for _ in range(3) for r in rows.mapInArrow(held, "pid bigint, n bigint").collect()}
    assert max(found.values()) >= 2


def test_training_order(docs, empty, tmp_path):
    assert sorted(training_order.slots(np.arange(997), 997)) == list(range(997))
    assert training_order.slots(np.arange(50), 50, "a").tolist() != training_order.slots(np.arange(50), 50, "b").tolist()
    m = training_order.materialise(docs, str(tmp_path / "o"), length=64, per_shard=100).collect()
    files = sorted(Path(tmp_path / "o").glob("part-*"))
    assert sorted(r["slot"] for r in m) == list(range(len(m))) and len(files) == -(-len(m) // 100)
    sp, seen = token_counts.Pieces(token_counts.MODEL).sp, Counter()
    for r in m:
        a = np.fromfile(files[r["shard"]], "<u2", 65, offset=r["byte_offset"]).tolist()
        seen[r["doc_id"], r["part"], tuple(a)] += 1
    want = Counter()
    for i, t in texts(docs):
        ids = sp.encode(t) + [2]
        for k in range(0, len(ids), 64):
            want[i, k // 64, tuple((ids[k : k + 64] + [2] * 65)[:65])] += 1
    assert seen == want
    assert training_order.materialise(empty).count() == 0


def test_training_order_of_filtered_rows(spark, docs, tmp_path):
    """Gaps that a filter leaves don't multiply the runs, and all rows have their slots."""
    docs.coalesce(2).write.parquet(str(tmp_path / "in"))
    some = spark.read.parquet(str(tmp_path / "in")).where("doc_id % 2 = 0")
    m = training_order.materialise(some, str(tmp_path / "o"), length=64, per_shard=50).collect()
    assert sorted(r["slot"] for r in m) == list(range(len(m))) and {r["folder"] for r in m} == {str(tmp_path / "o")}
    assert {r["doc_id"] for r in m} == {r["doc_id"] for r in some.collect()}
    rows = [(i % 9, i, f"f{i % 7}", i // 2, i % 5 + 1) for i in range(500)]
    runs = spark.createDataFrame(rows, "task int, piece int, run_file string, run_row bigint, n bigint")
    got, at = {(r["task"], r["piece"]): r["offset"] for r in training_order._offsets(runs).collect()}, 0
    for task, piece, _, _, n in sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1])):
        assert got[task, piece] == at
        at += n


@pytest.mark.parametrize("kind", ["exploded", "twice", "union", "shuffled"])
def test_training_order_of_rows_that_share_a_place(spark, docs, tmp_path, kind):
    """Rows that come twice from one place of a file have slots and bytes of their own."""
    path = str(tmp_path / "in")
    docs.coalesce(2).write.parquet(path)
    d = {
        "exploded": lambda: spark.read.parquet(path).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))),
        "twice": lambda: spark.read.parquet(path, path),
        "union": lambda: spark.read.parquet(path).unionByName(spark.read.parquet(path)).coalesce(1),
        "shuffled": lambda: spark.read.parquet(path).unionByName(spark.read.parquet(path)).repartition(3, "text"),
    }[kind]()
    m = training_order.materialise(d, str(tmp_path / "o"), length=64, per_shard=100).collect()
    files = sorted(Path(tmp_path / "o").glob("part-*"))
    assert sorted(r["slot"] for r in m) == list(range(len(m))) and sum(f.stat().st_size for f in files) == len(m) * 130
    sp, want = token_counts.Pieces(token_counts.MODEL).sp, Counter()
    seen = Counter((r["doc_id"], r["part"], np.fromfile(files[r["shard"]], "<u2", 65, offset=r["byte_offset"]).tobytes()) for r in m)
    for i, t in texts(docs):
        ids = sp.encode(t) + [2]
        for k in range(0, len(ids), 64):
            want[i, k // 64, np.array((ids[k : k + 64] + [2] * 65)[:65], "<u2").tobytes()] += 2
    assert seen == want


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for n, k in [(1, 1), (5, 2), (400, 2), (3000, 3), (3000, 60), (3000, 250), (30_000, 4)]:
        s = rng.integers(1, k + 1, n)
        t = np.concatenate([s, s[: n // 2], [0]])
        b = bytes(t.tolist())
        assert suffix_dedup.suffix_array(t, k + 1).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(docs, empty, hot):
    rows, n = texts(docs), 100
    seen = Counter(t.encode()[i : i + n] for _, t in rows for i in range(len(t.encode()) - n + 1))
    want = Counter()
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                gone[s : s + n] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        want[i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.dedup(docs, n, 40, hot).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(r["text"] is None or len(r["text"].encode()) <= r["n_bytes"] - r["n_removed"] for r in got)
    assert suffix_dedup.dedup(empty).count() == 0


def test_jaccard_join(docs, empty):
    rows = texts(docs.where("doc_id IS NOT NULL"))
    found, at = jaccard_join.distinct(pa.array([t for _, t in rows]))
    sets = [set(found[i:j].tolist()) for i, j in zip(at, at[1:], strict=False)]
    near = [[k for k, b in enumerate(sets) if k != i and a and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[k] for k in near[i])]) for i in range(len(rows))]
    first = {x: min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in set(label)}
    want = Counter((rows[i][0], first[label[i]], len(near[i])) for i in range(len(rows))) + Counter([(None, None, 0)])
    assert Counter(tuple(r) for r in jaccard_join.join(docs).collect()) == want
    assert jaccard_join.join(empty).count() == 0
    kept = [r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()]
    assert Counter(kept) == Counter([None, *{v for v in first.values()}])


def test_jaccard_join_stages_no_table_that_is_read_once(docs, monkeypatch):
    """Every file of a staged table costs an executor commands of its own (chmod) on a local file system."""
    made, stage = [], common.stage
    monkeypatch.setattr(common, "stage", lambda df, keep=None: (made.append(df.columns), stage(df, keep))[1])
    jaccard_join.join(docs).count()
    assert made
    assert not [c for c in made if c in (["one", "two"], ["node", "class_id", "n_links"]) or "chunk" in c]


def test_jaccard_join_of_rows_without_an_id(spark):
    """Null ids have their links; a class is named by its least id, or by none."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, a), (7, a), (9, a + " more"), (None, b), (None, b), (None, "alone here"), (None, None), (3, "x")]
    got = jaccard_join.join(spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, node string"))
    assert Counter(map(tuple, got.collect())) == Counter([(None, 7, 2), (7, 7, 2), (9, 7, 2), (None, None, 1), (None, None, 1), (None, None, 0), (None, None, 0), (3, 3, 0)])


def test_jaccard_join_of_split_groups(spark, monkeypatch):
    """A group of near copies of many sizes, in blocks of three: every link between blocks is found."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(160)]
    rows = [(i, " ".join(words[: 60 + 2 * i] + [f"own{i}"])) for i in range(45)] + [(100 + i, " ".join(words[:90])) for i in range(4)]
    found, at = jaccard_join.distinct(pa.array([t for _, t in rows]))
    sets = [set(found[i:j].tolist()) for i, j in zip(at, at[1:], strict=False)]
    want = {rows[i][0]: sum(k != i and len(a & b) >= 0.8 * len(a | b) for k, b in enumerate(sets)) for i, a in enumerate(sets)}
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    lost = {i: (n, got[i]) for i, n in want.items() if n != got[i]}
    assert sum(abs(a - b) for a, b in lost.values()) <= 0.002 * sum(want.values()), lost


def test_bands_reach_the_recall():
    b, r = jaccard_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 128


def statistics(items):
    from collections import defaultdict

    df, lengths = defaultdict(int), []
    for _, t in items:
        w = common.word_hashes(pa.array([t]))[0].tolist()
        if len(w) >= decontaminate.MIN_WORDS:
            lengths.append(len(w))
            for x in set(w):
                df[x] += 1
    return decontaminate.Statistics(len(lengths), float(np.mean(lengths)), max(lengths), df)


def test_decontamination(spark, docs, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, None), (901, "too short"), (None, "x"), (None, "zebra crossing wide")], "item_id bigint, text string"))
    items = {r["item_id"]: r["text"] for r in bench.where("item_id IS NOT NULL").collect()}
    planted = spark.createDataFrame([(1, f"{ODD[11]} {items[0]} some words after it"), (2, items[0].upper()), (3, None), (4, "far Too, SHORT"), (5, "too far short"), (6, "a zebra crossing wide road")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(planted.unionByName(docs, True), bench).collect()}
    want = {(i, k) for i, t in texts(docs) for k, x in items.items() if x and len(x) > 60 and x in t} | {(1, 0), (2, 0), (4, 901), (6, None)}
    assert want <= got and not {3, 5} & {i for i, _ in got}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark, monkeypatch):
    """Every passage against every item, with plain sums."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80).collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    items = sorted((r["item_id"], r["text"]) for r in bench.collect())
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(5000 + k, f"{rows[k]['text'][:300]} {' '.join(t.split()[: 10 + k])} {rows[k + 1]['text'][:300]}") for k, (_, t) in enumerate(items[:40])]
    stats, words = statistics(items), lambda t: common.word_hashes(pa.array([t]))[0].tolist()
    half = max(decontaminate.MIN_PASSAGE, stats.longest)
    idf = {w: max(np.log((stats.items - n + 0.5) / (n + 0.5)), 1e-3) for w, n in stats.df.items()}
    share = lambda part, passage: len(set(grams(part)) & set(grams(passage, min(5, len(part))))) / len(set(grams(part)))
    grams = lambda w, n=5: [tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)]
    weights = {}
    for k, t in items:
        tf = Counter(words(t))
        n = sum(tf.values())
        raw = {w: idf[w] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / stats.mean_length)) for w, c in tf.items()}
        weights[k] = {w: x / sum(raw.values()) for w, x in raw.items()}
    want = {}
    for i, t in rows:
        w = words(t)
        for at in range(0, len(w), half):
            passage = w[at : at + 2 * half]
            for k, own in weights.items():
                score = sum(own.get(x, 0) for x in set(passage))
                q, a = decontaminate.parts(dict(items)[k])
                if score >= 0.7 and share(words(q), passage) >= 0.5 and share(words(a), passage) >= 0.5 and score > want.get((i, k), 0) + 1e-9:
                    want[i, k] = score
    run = lambda: {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    got = run()
    assert got.keys() == want.keys() and len(got) > 10 and all(abs(got[x] - want[x]) < 1e-6 for x in got)
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 15)
    monkeypatch.setattr(decontaminate, "SEGMENT", 4)
    again = run()
    assert again.keys() == got.keys() and all(abs(got[x] - again[x]) < 1e-9 for x in got)


def test_wand_finds_all_above_the_threshold(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Index(items, statistics(items), 0.2)
    rng = np.random.default_rng(2)
    for _ in range(30):
        terms = np.unique(rng.integers(0, len(index.terms), 150))
        score = np.zeros(len(index.ids))
        for t in terms:
            np.add.at(score, index.items[index.starts[t] : index.starts[t + 1]], index.impact[index.starts[t] : index.starts[t + 1]])
        got = {i for b in range(index.blocks.shape[1]) for i, _ in index.wand(terms, b)}
        assert got == set(np.flatnonzero(score >= 0.2 - 1e-6).tolist())


def test_surrogates(spark, docs, empty):
    assert sorted(surrogates.permute(i, 97, "t") for i in range(97)) == list(range(97))
    t = "Mail ab.45@mail5.example.com or +1 (619) 555-1368, 56.219.191.68 card 4539578763621486 password=e3b3ed3cc8548923d6. Mr. John Smith; Mrs. Anna Smith, Mr Smith."
    a, b = (r["text"] for r in surrogates.pseudonymise(spark.createDataFrame([(1, t), (2, t + " ab.45@mail5.example.com")], "doc_id bigint, text string")).orderBy("doc_id").collect())
    assert b.startswith(a) and not any(v in a for *_, v in surrogates.entities(t))
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and len({*re.findall(r"(\w+)(?:;|,|\.$)", a[a.index("Mr.") :])}) == 1
    card = re.search(r"card (\d{16})", a)[1]
    assert surrogates._luhn(card[:-1]) == int(card[-1])
    got = surrogates.pseudonymise(docs)
    assert got.columns == [*docs.columns, "n_entities"] and got.where("text IS NULL").count() == 1 and got.count() == docs.count()
    assert surrogates.pseudonymise(empty).count() == 0


def test_surrogates_keep_coreference_scripts_and_columns(spark):
    make = lambda rows, schema="doc_id bigint, text string": surrogates.pseudonymise(spark.createDataFrame(rows, schema))
    rows = [(1, "Mr. John Smith met us. Smith agreed, JOHN SMITH too. The smith left Johnson."), (2, "Dr. John McAdam and Mrs. SMITH; McAdam."), (3, "Mr. Ιωάννης Παππάς και Mr 王小 明天")]
    a, b, c = (r["text"] for r in make(rows).orderBy("doc_id").collect())
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met us\. (\w+) agreed, (\w+) (\w+) too\. The smith left Johnson\.", a)
    assert m and m[2] == m[3] and (m[4], m[5]) == (m[1].upper(), m[2].upper()) and m[1] != "John" and m[2] != "Smith"
    n = re.fullmatch(r"Dr\. (\w+) (\w+) and Mrs\. (\w+); (\w+)\.", b)
    assert n and n[1] == m[1] and n[3] == m[2].upper() and n[2] == n[4]
    assert re.fullmatch(r"Mr\. [Α-ω]+ [Α-ω]+ και Mr [一-龥]+ [一-龥]+", c), c
    kept = make([(1, "Mr. Smith", 7)], "doc_id bigint, text string, n_entities int")
    assert kept.columns == ["doc_id", "text", "n_entities"] and kept.first()["n_entities"] == 7
    assert "surrogate" not in make([(1, "x")]).columns


def test_surrogates_are_distinct_and_consistent(spark):
    """Every mention of an entity gets one surrogate, other entities other ones, none of them real."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    new, seen = {r["doc_id"]: r["text"] for r in surrogates.pseudonymise(docs).collect()}, {}
    for r in docs.collect():
        found, at = surrogates.entities(r["text"]), 0
        if not found:
            assert new[r["doc_id"]] == r["text"]
        for k, (begin, end, kind, value) in enumerate(found):
            between = r["text"][(found[k - 1][1] if k else 0) : begin]
            assert new[r["doc_id"]].startswith(between, at)
            at += len(between)
            rest = r["text"][end : found[k + 1][0] if k + 1 < len(found) else None]
            stop = new[r["doc_id"]].index(rest, at) if rest else at + end - begin
            got = new[r["doc_id"]][at:stop]
            seen.setdefault((kind.split(":")[0], value), set()).add(got.capitalize() if surrogates.is_name(kind) else got)
            at = stop
    named = {k: v for k, v in seen.items() if k[0] in ("email", "phone", "card", "iban", "ssn", "ip", "secret", "surname")}
    assert len(named) >= 10 and all(len(v) == 1 for v in named.values())
    every = [x for v in named.values() for x in v]
    assert len(every) == len(set(every)) and not set(every) & {v for _, v in seen}


def test_colliding_surrogates_are_resolved(spark):
    names = spark.createDataFrame([("surname", f"Name{i}") for i in range(300)], "kind string, value string")
    got = surrogates.assign(names, 1).collect()
    assert len({r["surrogate"] for r in got}) == 300 and max(r["attempt"] for r in got) > 0


def test_surrogates_without_a_free_value_end(spark, monkeypatch):
    t = "password: ******** and password: 密码密码密码密码 end"
    new = surrogates.pseudonymise(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).first()["text"]
    assert "****" not in new and "密" not in new and new.startswith("password: ") and new.endswith(" end")
    ips = [f"192.168.{i}.{j}" for i in range(256) for j in range(256)]
    full = spark.createDataFrame([("ip", v) for v in ips], "kind string, value string")
    got = surrogates.assign(full, 3).toPandas()
    assert len(got) == got.surrogate.nunique() == len(ips) and not set(got.surrogate) & set(ips)
    names = [f"Mr. {chr(65 + i)}{chr(97 + j)}abcd" for i in range(26) for j in range(26)]
    docs = spark.createDataFrame([(i % 9, " and ".join(names[i : i + 4])) for i in range(0, 676, 4)] + [(None, t), (None, None)], "doc_id bigint, text string")
    rows = lambda: Counter(tuple(r) for r in surrogates.pseudonymise(docs).collect())
    monkeypatch.setitem(surrogates.SYLLABLES, "latin", surrogates.SYLLABLES["latin"][:30])
    assign = surrogates.assign
    monkeypatch.setattr(surrogates, "assign", lambda found, syllables, key: assign(found, 2, key).withColumn("attempt", F.lit(1)))
    few = rows()
    monkeypatch.setattr(surrogates, "MOST_EXCEPTIONS", 5)
    assert rows() == few and sum(few.values()) == docs.count()


def test_language_id(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, "12 34"), (None, "")], "doc_id bigint, text string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(odd, None).collect()} == {("und", 0.0)}
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0


def test_language_model_equals_plain_sums(spark):
    """The table of logits against embeddings averaged word by word, ties and rejection."""
    texts = pa.array(["Hello wörld, hello!", "", None, "1234 ab abc abcd", "x" * 5000 + " the end"], pa.large_string())
    found, at = langid.subwords(texts)
    rng = np.random.default_rng(2)
    m = langid.Model(["a", "b"], rng.normal(size=(1 << langid.BITS, 2)).astype(np.float32), np.array([0.1, -0.1], np.float32), 0.5, 0.6)
    best, score = m.predict(texts)
    for k, (i, j) in enumerate(zip(at, at[1:], strict=False)):
        z = (m.logits[found[i:j]].mean(axis=0) if j > i else np.zeros(2)) + m.bias
        p = np.exp(z / 0.5) / np.exp(z / 0.5).sum()
        assert best[k] == p.argmax() and abs(score[k] - p.max()) < 1e-4
    assert langid.Model(["a", "b"], np.zeros((1 << langid.BITS, 2), np.float32), np.zeros(2, np.float32)).predict(texts)[0].tolist() == [0] * 5
    docs = spark.createDataFrame([(1, "Hello wörld", "zz", "clash"), (1, "Hello wörld", None, "clash")], "doc_id bigint, text string, lang string, score string")
    rows = langid.identify(docs, m).collect()
    assert rows[0] == rows[1] and len(rows) == 2


def test_quality_model_equals_plain_sums(spark):
    """Levels, tails and expected grades against sums over words and stems in Python."""
    m = quality_model.Model(np.random.default_rng(3).normal(size=1 << quality_model.BITS), np.array([-1.0, 0.5]), 0.3)
    texts = ["Plain words, plain wording and Überlegungen", "", None, "a"]
    found, value, at = quality_model.features(pa.array(texts, pa.large_string()))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string")
    got = {r["doc_id"]: r for r in quality_model.classify(docs, m).collect()}
    for i in range(len(texts)):
        level = float((m.weights[found[at[i] : at[i + 1]]] * value[at[i] : at[i + 1]]).sum())
        tails = [1 - 1 / (1 + np.exp(-(t - level))) for t in (-1.0, 0.5)]
        assert abs(got[i]["expected_grade"] - sum(tails)) < 1e-6 and got[i]["kept"] == (tails[0] >= 0.3)
    n = np.diff(at)
    words = ["plain", "words", "wording", "and", "überlegungen"]
    assert n[0] == len(words) + len({(w[:k], k) for w in words for k in quality_model.STEMS if len(w) > k}) and n[1] == n[2] == 0


def test_quality_model_on_real_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    m = quality_model.train(docs, quality_model.graded(labels.where(half)))
    got = quality_model.classify(docs, m).join(quality_model.graded(labels.where(~half)), "doc_id").toPandas()
    means = got.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2] and got[got.grade == 2].kept.mean() > 0.9


def test_quality_model(spark, docs, empty):
    words = [f"w{i}" for i in range(50)]
    rng = np.random.default_rng(3)
    make = lambda g: " ".join(rng.choice(words, 60)) + (" vile nasty" * 3 if g == 0 else " fine lovely" * 3 if g == 2 else "")
    rows = [(i, make(i % 3), i % 3) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, g int")
    m = quality_model.train(d, d.where("doc_id < 200").select("doc_id", F.col("g").alias("grade")))
    assert m.thresholds[0] < m.thresholds[1]
    got = quality_model.classify(d.where("doc_id >= 200"), m).join(d, "doc_id").toPandas()
    means = got.groupby("g").expected_grade.mean()
    assert means[0] < means[1] < means[2] and got[got.g == 0].kept.mean() < 0.2 and got[got.g == 2].kept.mean() > 0.8
    assert quality_model.classify(docs, None).where("kept").count() == docs.count() and quality_model.classify(empty, m).count() == 0


def test_quality_model_knows_inflected_and_repeated_words(spark):
    rng = np.random.default_rng(5)
    some = lambda k: "".join(rng.choice(list("abdefgiklmnoprstu"), k))
    words = [some(6) for _ in range(200)]

    def make(g):
        w = [*rng.choice(words, 150), *(f"réeux{some(4)}" for _ in range(4 * (g == 0)))]
        return " ".join(rng.permutation(w))

    d = spark.createDataFrame([(i, make(i % 3), i % 3) for i in range(600)], "doc_id bigint, text string, g int")
    m = quality_model.train(d, d.where("doc_id < 400").select("doc_id", F.col("g").alias("grade")))
    got = quality_model.classify(d.where("doc_id >= 400"), m).join(d, "doc_id").toPandas()
    assert got[got.g == 0].kept.mean() < 0.1 and got[got.g == 2].kept.mean() > 0.9
    assert quality_model.shares({0: 10, 1: 100, 2: 1000}, 210) == {0: 1.0, 1: 1.0, 2: 0.1}


def test_quality_model_learns_from_every_rating(spark):
    """More ratings than the earlier sample of 6,000: no small change of a parameter lowers the loss over all rows that
    aren't held back, the limit is the quantile of all that are, and neither depends on how rows are dealt out."""
    rng, chances = np.random.default_rng(8), ([0.6, 0.2, 0.2], [0.3, 0.4, 0.3], [0.2, 0.2, 0.6])
    grades = rng.choice(3, 9000, p=[0.2, 0.3, 0.5])
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef"], 1 + i % 4, p=chances[g])), int(g)) for i, g in enumerate(grades)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, g int")
    m, other = (quality_model.train(d.repartition(k, "doc_id"), d.select("doc_id", F.col("g").alias("grade"))) for k in (1, 5))
    assert m.weights.tolist() == other.weights.tolist() and m.thresholds.tolist() == other.thresholds.tolist() and m.min_clean == other.min_clean
    held = {r[0] for r in d.where(F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(1000)) < 250).select("doc_id").collect()}
    found, value, at = quality_model.features(pa.array([t for _, t, _ in rows], pa.large_string()))
    used = np.unique(found)
    x = np.zeros((len(rows), len(used)))
    x[np.repeat(np.arange(len(rows)), np.diff(at)), np.searchsorted(used, found)] = value
    learned = np.array([i not in held for i, _, _ in rows])
    assert len(used) == 3 and 6000 < learned.sum() < len(rows)

    def loss(p):
        cum = 1 / (1 + np.exp(-(np.array([-np.inf, p[0], p[1], np.inf])[None, :] - (x[learned] @ p[2:])[:, None])))
        own = np.arange(learned.sum()), grades[learned]
        return -np.log(cum[own[0], own[1] + 1] - cum[own]).mean() + quality_model.PENALTY * np.abs(p[2:]).sum()

    best = np.concatenate([m.thresholds, m.weights[used]])
    assert all(loss(best + step * one) > loss(best) - 2e-6 for one in np.eye(5) for step in (-0.004, 0.004))
    p = m.tails(x[~learned] @ best[2:])[:, 0]
    assert abs(m.min_clean - np.quantile(p[grades[~learned] == 2], quality_model.LOSS)) < 1e-6


def test_quality_rules(docs, empty):
    want = Counter()
    for i, t in texts(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {p + k for p, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    got = quality_rules.apply_rules(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(r) for r in got.select(names).collect()) == want
    assert got.where("base_failed AND kept").count() == 0 and quality_rules.apply_rules(empty).count() == 0


def test_quality_rules_reject_texts_without_common_words(spark):
    rng = np.random.default_rng(7)
    rare = ["".join(rng.choice(list("bcdfgklmnprstvz"), 6)) for _ in range(500)]
    plain = lambda n: [str(rng.choice(quality_rules.COMMON_WORDS["en"] if rng.random() < 0.25 else rare)) for _ in range(n)]
    rows = [(i, " ".join(plain(int(n))), "en") for i, n in enumerate(rng.integers(60, 600, 200))]
    rows += [(1000 + i, " | ".join(rng.choice(rare, n)), "en") for i, n in enumerate((30, 60, 100, 300))]
    d = spark.createDataFrame([(i, t, x) for i, t, x in rows], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(d).collect()}
    hists = {i: np.bincount([quality_rules.WORDS.index(w) + 1 if w in quality_rules.WORDS else 0 for w in t.split()], minlength=len(quality_rules.WORDS) + 1) / len(t.split()) for i, t, _ in rows}
    ref = np.mean([h for i, h in hists.items() if not got[i]["base_failed"]], axis=0)
    least = (1 - ref[0]) / 3
    entropy = lambda p: -sum(x * np.log2(x) for x in p if x > 0)
    dist = {i: np.sqrt(max(0, entropy((h + ref) / 2) - (entropy(h) + entropy(ref)) / 2)) for i, h in hists.items()}
    clean = sorted(round(dist[i] * np.sqrt(got[i]["n_words"]), 2) for i, h in hists.items() if 1 - h[0] >= least and not got[i]["base_failed"])
    mid, low = clean[-(-len(clean) // 2) - 1], clean[int(np.ceil(0.16 * len(clean))) - 1]
    limit = max(mid + 4 * (mid - low), 1.5 * mid)
    for i, h in hists.items():
        assert abs(got[i]["word_distance"] - dist[i]) < 1e-5
        want = 1 - h[0] >= least and dist[i] * np.sqrt(got[i]["n_words"]) <= limit and got[i]["char_distance"] <= 0.25 and not got[i]["base_failed"]
        assert got[i]["kept"] == want, i
    assert not any(got[1000 + k]["kept"] for k in range(4)) and sum(got[i]["kept"] for i in range(200)) >= 198
    assert any(got[1000 + k]["char_distance"] <= 0.25 for k in range(4))


def test_quality_rules_know_other_languages_and_classes(spark):
    rng = np.random.default_rng(8)

    def words(letters, n):
        return " ".join("".join(rng.choice(list(letters), int(rng.integers(2, 9)))) for _ in range(n))

    latin = lambda n: " ".join(str(x) for x in rng.choice(quality_rules.COMMON_WORDS["en"] + words("abcdefghilmnoprst", 60).split(), n))
    greek, han = [chr(c) for c in range(0x3B1, 0x3CA)], [chr(c) for c in range(0x4E00, 0x4F00)]
    rows = [(i, latin(90), "en") for i in range(20)] + [(100 + i, words(greek, 90), "el") for i in range(20)]
    rows += [(200, words(han, 80), "zh"), (201, words(han, 80), None), (202, words("0123456789", 90), "el"), (203, latin(90), "el"), (204, words(greek, 90), None)]
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in [*range(20), *range(100, 120)])
    assert got[200]["kept"] and got[200]["char_distance"] is None  # a language without a reference
    assert not got[201]["kept"] and not got[202]["kept"] and got[203]["kept"]
    # Character histograms against plain Python.
    point = ".,;:!?'\"()-"

    def classes(t):
        out = [sum(c.isascii() and c.isupper() for c in t), sum(c.isascii() and c.isdigit() for c in t), sum(c in point for c in t), sum(c in "#*$%&|<>" for c in t), t.count(" "), sum("\x80" <= c <= "ɏ" for c in t), sum(c > "ɏ" for c in t)]
        return np.array([*out, len(t) - sum(out)]) / len(t)

    # Equal histograms (here: of texts as long, with the same common words) count once.
    refs = [np.mean([*{(*classes(t), *sorted(w for w in t.split() if w in quality_rules.WORDS)): classes(t) for i, t, x in rows if x == lang and not got[i]["base_failed"]}.values()], axis=0) for lang in ("en", "el")]
    entropy = lambda p: -sum(x * np.log2(x) for x in p if x > 0)
    for i, t, lang in rows:
        if lang != "zh":
            p = classes(t)
            want = min(np.sqrt(max(0, entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2)) for q in refs)
            assert abs(got[i]["char_distance"] - want) < 1e-5


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out.cache()
    assert 0 < docs.count() < n
    made = corpus_pipeline.run(spark, SF).collect()
    assert len(made) == docs.count()
    lib = Tokenizer.from_file(token_counts.model_path(bpe.MODEL))
    want = Counter((r["doc_id"], *lib.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect())
    assert Counter((r["doc_id"], *r["ids"]) for r in made) == want


@pytest.mark.parametrize("clash", [False, True])
def test_pipeline_stages_on_odd_tables(spark, clash):
    import corpus_pipeline

    names = "h1 h2 gone_id no_id id words n node block key bytes spans n_entities _odd class_id value kind".split() if clash else []
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", {n} string" for n in names)
    empty = spark.createDataFrame([], schema)
    some = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(8).collect()]
    texts = [None, "", " \n", *some, some[0], some[1] * 40, "x" * 9000]
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, t, None if i % 2 else "en", None, None, *["clash"] * len(names)) for i, t in enumerate(texts)], schema)
    for name, stage in corpus_pipeline.STAGES:
        nothing, out = stage(spark, empty, SF), stage(spark, docs, SF)
        assert nothing.count() == 0, name
        if name == "encoding":
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in docs.collect())
            break
        assert nothing.columns == out.columns == docs.columns, name
        found, before = Counter(tuple(r) for r in out.drop("text", "n_chars").collect()), Counter(tuple(r) for r in docs.drop("text", "n_chars").collect())
        assert not found - before, name


def test_pipeline_drops_rows_and_not_ids(spark):
    import corpus_pipeline

    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").first()["text"]
    rng = np.random.default_rng(9)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(80))
    a, b, c = text(), text(), text()
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    rows = [(None, a, "en"), (None, "few words", "en"), (None, f"{b} {item}", "en"), (7, c, "en"), (7, "short", "en"), (8, b, "en"), (8, f"{a} {item}", "en")]
    kept = lambda stage, rows: Counter(tuple(r) for r in stage(spark, make(rows), SF).collect())
    assert kept(corpus_pipeline.quality, rows) == Counter(r for r in rows if len(r[1]) > 20)
    assert kept(corpus_pipeline.decontamination, rows) == Counter(r for r in rows if item not in r[1])
    rows = [(5, a, "en"), (5, b, "en"), (3, f"{b} tail", "en"), (9, a, "en"), (None, c, "en"), (None, c, "en"), (None, a, "en"), (6, c, "en"), (None, text(), "en"), (None, text(), "en")]
    assert kept(corpus_pipeline.near_duplicates, rows) == Counter([rows[0], rows[2], rows[7], *rows[8:]])
