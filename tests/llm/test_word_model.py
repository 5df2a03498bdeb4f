"""The quality classifier's word model: against brute force, growing with the corpus, sensitive to the order of words."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderplan.llm import quality_lm

WORDS = [a + b for a in "alpha beta gamma delta epsilon zeta".split() for b in "rho sigma tau upsilon".split()]


def sentences(n, rng):
    """Texts in which each word mostly decides the next."""
    out = []
    for _ in range(n):
        k, words = rng.randrange(len(WORDS)), []
        for _ in range(80):
            words.append(WORDS[k])
            k = (k * 5 + 1) % len(WORDS) if rng.random() < 0.9 else rng.randrange(len(WORDS))
        out.append(" ".join(words))
    return out


def folds(spark, n):
    return {r.doc_id: r.f for r in spark.range(n).withColumnRenamed("id", "doc_id").select("doc_id", quality_lm.fold().alias("f")).collect()}


def brute_force(texts, c, f):
    """-ln p of a text under fold f's trusted texts, word by word and, for what they have never had, character by character."""
    grams = collections.Counter(g for t in texts for g in zip(["", "", *t.split()], ["", *t.split()], t.split()))
    levels = [grams]
    for _ in range(2):
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    cuts = [quality_lm.discounts(quality_lm.counted(np.array(list(x.values())))) for x in levels]
    logs = np.frombuffer(b"".join(quality_lm.model(c.where(F.col("fold") == f).select("code", "n"))), np.uint8)

    def p(g, spelled):
        if not g:
            return spelled
        level, d = levels[3 - len(g)], cuts[3 - len(g)]
        after = {x[-1]: n for x, n in level.items() if x[:-1] == g[:-1]}
        if not after:
            return p(g[1:], spelled)
        total = sum(after.values())
        left = sum(d[min(n, 3) - 1] for n in after.values())
        n = after.get(g[-1], 0)
        return ((n - d[min(n, 3) - 1]) if n else 0) / total + left / total * p(g[1:], spelled)

    def nll(text):
        spelled = logs[quality_lm.codes([text], quality_lm.symbol_table())[0]] / quality_lm.STEPS
        w = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        inside = sum(spelled[a:b].sum() for a, b, _ in w)
        words = [x for _, _, x in w]
        grams = zip(["", "", *words], ["", *words], words)
        return spelled.sum() - inside - sum(np.log(p(g, np.exp(-spelled[a:b].sum()))) for g, (a, b, _) in zip(grams, w, strict=False))

    return nll


@pytest.mark.parametrize("small", [False, True])
def test_perplexity_and_thresholds_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and shards
        monkeypatch.setattr(quality_lm, "SHARD_CHARS", 500)
        monkeypatch.setattr(quality_lm, "BLOCK_BYTES", 700)
        monkeypatch.setattr(quality_lm, "PIECE_BYTES", 300)
    texts = sentences(36, random.Random(1))
    texts += [" ".join(random.Random(2).sample(WORDS, 20)) + " never seen\tBefore ", "x", "Ünheard " * 3]
    f, n = folds(spark, len(texts)), 30
    d = spark.createDataFrame([(k, ["en", "fr"][k % 2], t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    monkeypatch.setattr(quality_lm, "LEAST", 1)
    got = {r.doc_id: r for r in quality_lm.judged(d, labels).collect()}
    assert len(got) == len(texts)
    c = quality_lm.counts(d.where(F.col("doc_id") < n))
    judges = [brute_force([t for k, t in enumerate(texts[:n]) if f[k] == x], c, x) for x in range(2)]
    want = {k: judges[1 - f[k]](t) for k, t in enumerate(texts)}
    for k, t in enumerate(texts):
        assert got[k].n_chars == len(t) and abs(got[k].nll - want[k]) < 2e-3 * want[k], k
    for lang in ("en", "fr"):
        mine = [k for k in range(n) if ["en", "fr"][k % 2] == lang]
        typical = sum(want[k] for k in mine) / sum(len(texts[k]) for k in mine)
        mean = {k: (want[k] + quality_lm.PSEUDO * typical) / (len(texts[k]) + quality_lm.PSEUDO) for k in got if got[k].lang == lang}
        limit = sorted(mean[k] for k in mine)[int(np.ceil(quality_lm.QUANTILE * len(mine))) - 1]
        assert all(got[k].kept == (mean[k] <= limit) for k in mean if abs(mean[k] - limit) > 1e-2)
        assert all(abs(np.log(got[k].threshold) - limit) < 1e-2 for k in mean)


def test_word_keys_of_odd_texts():
    begin, end, doc, keys = quality_lm.word_keys(["", " ab\ncd", "", "ab", "中文", " "])
    assert [(b, e) for b, e in zip(begin.tolist(), end.tolist())] == [(1, 3), (4, 6), (6, 8), (8, 9), (9, 10)]
    assert doc.tolist() == [1, 1, 3, 4, 4] and keys[0] == keys[2] and len(set(keys.tolist())) == 4
    v = quality_lm.after(keys, np.diff(doc, prepend=-1) > 0, np.uint64(0))
    assert v.tolist() == [0, keys[0], 0, 0, keys[3]]
    assert all(len(x) == 0 for x in quality_lm.word_keys(["", " "]))


def test_places_ascend_and_blobs_round_trip():
    rng = np.random.default_rng(1)
    k = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    for n in (1, 3, 1000):
        at = quality_lm.place(k, n)
        assert (np.diff(at.astype(object)) >= 0).all() and int(at.max() >> np.uint64(32)) < n
        cells = quality_lm.by_shard(at, n)
        assert sum(s.stop - s.start for _, s in cells) == 1000
    x = rng.integers(0, 50, 300, dtype=np.uint64)
    found, number = quality_lm.ranked(x)
    assert (found == np.unique(x)).all() and (found[number] == x).all() and (quality_lm.distinct(x) == found).all()
    low = np.unique(rng.integers(0, 2**32, 500, dtype=np.uint32))
    assert (quality_lm.ungapped(quality_lm.gaps(low)) == low).all()
    assert quality_lm.unbundle(quality_lm.bundle([b"", b"ab", b"c"])) == [b"", b"ab", b"c"]
    x = np.array([1e-3, 0.5, 1, 7, 1e9])
    assert np.allclose(quality_lm.from_logs(quality_lm.as_logs(x), 0.0), x, rtol=6e-4) and quality_lm.from_logs(np.zeros(1, np.uint16), 3.0) == 3


@pytest.mark.all_waves
def test_senseless_order_and_growth(spark):
    rng = random.Random(3)
    texts = sentences(120, rng)
    mixed = [" ".join(rng.sample(t.split(), 80)) for t in texts[100:]]
    d = spark.createDataFrame([(k, "en", t) for k, t in enumerate([*texts, *mixed])], "doc_id long, lang string, text string")
    labels = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    by = {r.doc_id: r.perplexity for r in quality_lm.judged(d, labels).collect()}
    assert all(by[k + 20] > 1.2 * by[k] for k in range(100, 120))
    few, many = (quality_lm.WordModel(d.where(f"doc_id < {n}").select("text"), 2).table.agg(F.sum(F.length("blob"))).first()[0] for n in (20, 100))
    assert many > 1.5 * few
