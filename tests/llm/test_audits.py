"""Chat formatting, filter interactions and source divergence against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake.llm import chat_format, filter_audit, source_audit

SF = "/root/testdata/sf0.001"
TURNS = "conv_id bigint, turn bigint, role string, text string, piece string, n int, `end` int"
DOCS = "doc_id bigint, text string, lang string, source string, part string, n bigint, bits int, h1 string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def turns():
    rng = random.Random(5)
    bits = ["[", "<", "\\", "INST]", "/INST]", "s>", "/s>", "SYS]", "IS]", "/ROLE]", "[INST]", "</s>", "<s>", "[\\INST]", "<\\\\/s>", " ", "é", "\n", "]", "$1", "中"]
    roles = ["user", "assistant", "system", "tool", "[IS]", "", None, "a[\\IS]b"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choices(bits, k=rng.randrange(9)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, r, x) for t, r, x in [(0, "user", None), (0, "user", "b"), (0, "user", "b"), (0, "assistant", "z"), (None, "assistant", "first"), (1, None, None)]]
    rows += [(None, 1, "user", "no id"), (None, 0, "assistant", "x" * 300_000 + "</s>")]
    rows += [(200, t, "assistant" if t % 2 else "user", f"{t} [INST] \\ {t}") for t in range(2000)]
    return rows


def test_chats_come_back(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], TURNS).repartition(5)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    chats = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by) == set(chats)
    for c, own in by.items():
        own, r = sorted(own), got[c]
        loss = "".join(x for *_, role, x in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == sha("".join(f"{role}\n{x}\n" for *_, role, x in own))
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == sha(loss)
        text = chats[c]["formatted"]
        assert r["formatted_chars"] == len(text) == sum(map(len, re.findall(chat_format.PIECE, text)))
        mine = [x for *_, role, x in own if role == "assistant"]
        spans = [text[s["start"] : s["end"]] for s in chats[c]["loss_spans"]]
        assert [re.sub(r"([\[<])\\(\\*)" + chat_format._REST, r"\1\2\3", s) for s in spans] == mine
        # No control string inside a text survives: those there are belong to the template.
        assert len(re.findall(chat_format.CONTROL, text)) == sum(2 if role in chat_format.OPEN else 3 for *_, role, _ in own)
        assert r["escaped_turns"] == sum(bool(re.search(r"[\[<]\\*" + chat_format._REST, x + ("" if role in chat_format.OPEN else "\0" + role))) for *_, role, x in own)
    assert chat_format.read_back(chat_format.format_chats(df.where("false"))).count() == 0


@pytest.mark.parametrize("text", ["x", "[INST]a", "[INST]a[/INST]b", "a[INST]b[/INST]", "[INST]a[INST]b[/INST]", "<s>a[/INST]</s>", "[ROLE]a[/ROLE]", "[INST]a</s>b[/INST]"])
def test_the_parser_refuses_other_texts(spark, text):
    assert spark.range(1).select(chat_format.parse(F.lit(text)).alias("t")).first()["t"] is None


def documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").limit(120).collect()]
    rows += [(10_000 + i, rows[i][1], "en", s) for i in range(15) for s in ("src0", None, "")]
    rows += [(None, rows[3][1], None, "src1"), (None, None, "xx", None), (5, rows[5][1], rows[5][2], rows[5][3]), (20_000, None, "xx", "a"), (-3, "", None, "b"), (7, "AB CD # é", "xx", "only")]
    rows += [(30_000, "word ß Öl " * 40_000, "de", "src2"), (30_001, "A" * 300, "xx", "a"), (30_002, " ".join(f"w{i}" for i in range(250)), "yy", "a"), (30_003, "same x " * 199 + "x", "yy", "b")]
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash") for r in rows], DOCS).repartition(4), rows


def test_filter_audit(spark):
    docs, rows = documents(spark)
    marks = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 60, 2)] + [(4, True, False), (4, False, True), (None, True, True), (10_001, True, True)]
    labels = spark.createDataFrame([(i, int(q), int(t), "clash") for i, q, t in marks] + [(8, None, None, "clash")], "doc_id bigint, quality int, toxic int, source string")
    least, n = {}, Counter()
    for i, x, *_ in rows:
        if i is not None:
            least[x or ""] = min(i, least.get(x or "", i))
    for i, x, _, source in rows:
        x = x or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", x)) > 2 * len(x), bool(re.search(r"[#$%&*|]", x)), i is not None and i > least[x])
        n[source or "", fails, any(q for k, q, _ in marks if k == i and i is not None), any(t for k, _, t in marks if k == i and i is not None)] += 1
    want = {}
    for part in {k[0] for k in n}:
        own, shapley = [(k, v) for k, v in n.items() if k[0] == part], Counter()
        for order in permutations(range(5)):
            for step in range(5):
                f, before = order[step], order[:step]
                here = [(k, v) for k, v in own if k[1][f] and not any(k[1][g] for g in before)]
                kept = sum(v for k, v in own if not any(k[1][g] for g in order[: step + 1]))
                removed = sum(v for _, v in here)
                shapley[f] += removed
                want[part, "".join("ABCDE"[g] for g in order), step + 1] = [
                    kept, removed, sum(v for k, v in own if k[1][f] and any(k[1][g] for g in before)), sum(v for k, v in own if k[1][f] and sum(k[1]) == 1),
                    sum(v for k, v in here if k[2]), sum(v for k, v in here if k[3]), f,
                ]
        for k, v in want.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    got = filter_audit.audit(docs, labels).collect()
    assert {tuple(r)[:3]: list(tuple(r)[3:]) for r in got} == want and len(got) == len(want)
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert filter_audit.audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0


def test_filter_audit_gives_parts_on(spark, monkeypatch):
    """More parts than a task holds are given on in pieces, and the pieces add up."""
    counts = np.arange(32 * 4).reshape(32, 4)
    both = filter_audit.arrays(counts) + filter_audit.arrays(counts[::-1])
    assert (filter_audit.arrays(counts + counts[::-1]) == both).all()
    docs = spark.range(5000).select("id", F.concat(F.lit("p"), F.col("id") % 2500).alias("source"), F.lit("a b #").alias("text")).withColumnRenamed("id", "doc_id")
    got = filter_audit.audit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).where("filter_order = 'DABCE' AND step = 1")
    assert got.count() == 2500 and got.agg(F.sum("removed")).first()[0] == 5000


def brute_divergence(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    seen, all_, own, groups = Counter(), Counter(), Counter(), {(x, s) for x, s, _ in docs}
    for lang, source, terms in docs:
        seen.update((lang, t) for t in set(terms))
        all_.update((lang, t) for t in terms)
        own.update((lang, source, t) for t in terms)
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(t for (x, t), n in seen.items() if x == lang and n >= 3)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        count = {s: {t: own[lang, s, t] for t in kept} for x, s in groups if x == lang}
        ps, q = {s: p(c) for s, c in count.items()}, p({t: all_[lang, t] for t in kept})
        for s in count:
            pairs = [(-sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o) for o in count if o != s]
            terms = [(-((ps[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if count[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize(("in_flight", "block"), [(source_audit.IN_FLIGHT, source_audit.BLOCK), (1, 7), (40_000, 300)])
def test_source_divergence(spark, in_flight, block):
    docs, rows = documents(spark)
    if in_flight == 1:  # a shuffle for each round: fewer sources
        docs, rows = docs.where("source IS NULL OR source < 'src14'"), [r for r in rows if r[3] is None or r[3] < "src14"]
    got = source_audit.audit(docs, in_flight, block).collect()
    assert Counter(map(tuple, got)) == Counter(brute_divergence(rows))
    assert {"xx", "", "yy"} <= {r["lang"] for r in got}
    assert source_audit.audit(docs.where("false"), in_flight, block).count() == 0


def test_shares_are_exact():
    rng, total = random.Random(2), 9 * 10**15
    c = [0, 1, total - 1, *(rng.randrange(total) for _ in range(200))]
    assert source_audit.share(np.array(c), total).tolist() == [1 + 10**9 * (x + 1) // total for x in c]
    text = ("ab" * 700_000 + " " + "Öl cd " * 300_000).encode()
    assert sum(source_audit.term_runs(text), []) == source_audit.TERM.findall(text.lower())


def test_every_two_slots_meet_once(spark):
    for n in (1, 2, 3, 8, 9):
        pieces = spark.range(n).select(F.lit("x").alias("lang"), F.col("id").cast("int").alias("slot"), F.lit(n).alias("groups"), F.lit(0).alias("block"))
        met = Counter()
        for first in range(0, n + 1, 2):
            met.update(frozenset((r["slot"], r["dest"])) for r in source_audit._rounds(pieces, first, first + 1).where("slot <> dest").collect())
        assert met == Counter(frozenset((i, j)) for i in range(n) for j in range(i))


def test_heaps_keep_the_best_over_many_batches():
    """Batches of one row and many ties: nothing that belongs to the best is lost."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = [("en", "s", f"t{k}", rng.randrange(1, 12), 1, 1000, 100_000) for k in range(900)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "term", "c", "whole", "total", "lang_total"), r, strict=True))]) for r in rows]
    got = [tuple(r.values()) for b in source_audit.best_terms(iter(batches)) for r in b.to_pylist()]
    p = lambda c, n: 1 + 10**9 * (c + 1) // n
    want = sorted((-((p(c, 1000) - p(1, 100_000)) ** 2 // p(1, 100_000)), t) for _, _, t, c, *_ in rows)[:200]
    assert got == [("en", "s", t, -v) for v, t in want]
