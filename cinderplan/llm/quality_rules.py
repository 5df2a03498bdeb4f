"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides.

Everything is built-in expressions. Documents are never shuffled; only counts per pattern of votes (3 ** number of rules at
most) are, and they are what expectation-maximisation runs on, as one SQL expression.

Defined results: a null or empty text has no words, fails the base rules and is not kept; an empty table gives an
empty one; repeated rows are judged alike; other columns of the input pass through ``annotated`` unless they bear a
name of its results, or ``_x`` or ``_f`` (``accepted`` returns all columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderplan.llm.common import SPACE, let, stored, words

WINDOW = 8
#: A word of letters, with inner hyphens or apostrophes, quotes around it and a mark after it.
PLAIN = r"^[\"'(\u201c\u201e\u00ab\u00bf\u00a1]?\p{L}+(?:['\u2019-]\p{L}+)*[\"')\u201d\u00bb]?[.,;:!?]?[\"')\u201d\u00bb]?$"
MIN_WORDS = 20
REPEAT_PERCENT = 30
ROUNDS = 30
#: First guesses: share of good documents; a detector's and a two-sided rule's shares of bad votes, abstentions and good
#: votes on good and on bad documents. They also count as STRENGTH votes in every round.
PRIOR, STRENGTH = 0.9, 20.0
DETECTOR = ((0.005, 0.985, 0.01), (0.2, 0.79, 0.01))
TWO_SIDED = ((0.005, 0.295, 0.7), (0.3, 0.5, 0.2))

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_letters", "n_upper", "n_stops", "n_plain"]
OWN = [*BASE, *MORE, "votes", "base_failed", "posterior", "kept"]


def repeat_words(found: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words that occur twice or more in the text, the first occurrence included.

    Windows are told apart by a 64-bit hash first; only where two hashes agree are the windows themselves sorted.
    """
    n = F.size(found) - (window - 1)
    at = F.sequence(F.lit(1), n)
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(found, i, window)))
    doubtful = F.size(F.array_distinct(hashes)) < n
    gram = F.transform(at, lambda i: F.struct(F.array_join(F.slice(found, i, window), " ").alias("g"), i.alias("i")))

    def covered(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, k: (x["g"] == F.get(pairs, k - 1)["g"]) | (x["g"] == F.get(pairs, k + 1)["g"]))
        starts = F.sort_array(F.transform(same, lambda x: x["i"]))
        first = F.lit(-window).cast("int")
        total = F.aggregate(starts, F.struct(F.lit(0).alias("n"), first.alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"), i.alias("last")))
        return total["n"]

    return F.when((n >= 2) & doubtful, F.coalesce(let(F.array_sort(gram), covered), F.lit(0))).otherwise(0).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """docs with the columns of BASE and MORE, all longs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c.lower() not in {x.lower() for x in OWN} | {"_x", "_f"}]
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # each step is exploded from an array of one: nothing is pushed below that, so no list is made again for each word
    d = docs.select(*keep, F.explode(F.array(F.struct(words(text).alias("w"), lines.alias("l"), F.regexp_replace(text, SPACE + "+", "").alias("c")))).alias("_x"))
    w, l, c = F.col("_x.w"), F.col("_x.l"), F.col("_x.c")  # noqa: E741
    found = {
        "n_words": F.size(w),
        "word_chars": F.length(c),
        "n_symbols": F.length(c) - F.length(F.translate(c, "#*$%&|<>", "")),
        "n_dup_lines": F.size(l) - F.size(F.array_distinct(l)),
        "n_repeat_words": repeat_words(w),
        "n_lines": F.size(l),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_letters": F.length(F.regexp_replace(c, r"\P{L}+", "")),
        "n_upper": F.length(F.regexp_replace(c, r"\P{Lu}+", "")),
        "n_stops": F.length(F.regexp_replace(c, r"[^.!?;:。]+", "")),
        "n_plain": F.size(F.filter(w, lambda x: x.rlike(PLAIN))),
    }
    d = d.select(*keep, F.explode(F.array(F.struct(*(v.cast("long").alias(k) for k, v in found.items())))).alias("_f"))
    return d.select(*keep, "_f.*")


def _vote(bad: Column, good: Column | None = None) -> Column:
    """0 for bad, 2 for good, 1 to abstain."""
    return F.when(bad, 0).when(F.lit(False) if good is None else good, 2).otherwise(1)


#: Which rules can vote good.
KINDS = [DETECTOR, DETECTOR, DETECTOR, DETECTOR, DETECTOR, TWO_SIDED, TWO_SIDED, TWO_SIDED]


def rules() -> list[Column]:
    """Each rule's vote, in the order of KINDS. Integer arithmetic only, so that any engine gives the same votes."""
    n, chars, symbols, dup, rep, lines, distinct, letters, upper, stops, plain = (F.col(c) for c in [*BASE, *MORE])
    return [
        _vote(symbols * 10 > chars),
        _vote(rep * 5 > n),
        _vote(dup * 3 > lines),
        _vote((letters >= 20) & (upper * 2 > letters)),
        _vote((chars > n * 15) | (chars < n * 2)),
        _vote((n >= 20) & (distinct * 5 < n), (n >= 20) & (distinct * 5 > n * 2)),
        _vote((n >= 40) & ((stops * 100 < n) | (stops > n)), (n >= 20) & (stops * 40 >= n) & (stops * 3 <= n)),
        _vote((n >= 20) & (plain * 10 < n * 6), (n >= 20) & (plain * 10 >= n * 9)),
    ]


def voted(docs: DataFrame) -> DataFrame:
    """features(docs) with votes (the rules' votes as digits of base 3, the first rule's the lowest) and base_failed."""
    votes = sum((v * 3**j for j, v in enumerate(rules())), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return features(docs).withColumns({"votes": votes.cast("int"), "base_failed": failed})


def em_expression(kinds: list = KINDS, rounds: int = ROUNDS) -> str:
    """SQL for the posterior of each entry of ``pats``, an array of (votes, n) in order, after EM.

    State: prior, the share of good documents, and for each rule and class the shares of its bad votes, abstentions and
    good votes. A rule's accuracy on a class is what it votes rightly there; an abstention counts as its shares say.
    """
    js = range(len(kinds))
    digit = [f"((p.votes div {3**j}) % 3)" for j in js]
    logit = "ln(s.prior / (1 - s.prior))" + "".join(f" + ln(s.good[{j}][{digit[j]}] / s.bad[{j}][{digit[j]}])" for j in js)
    post = f"transform(pats, p -> named_struct('votes', p.votes, 'n', p.n, 'q', 1 / (1 + exp(-({logit})))))"

    def total(value: str) -> str:
        return f"aggregate(x, 0D, (a, p) -> a + {value})"

    def shares(of: str, which: int) -> str:
        def one(j: int, v: int) -> str:
            return f"({total(f'case when {digit[j]} = {v} then {of} else 0D end')} + {STRENGTH * kinds[j][which][v]!r}D) / ({total(of)} + {STRENGTH}D)"

        return "array(" + ", ".join("array(" + ", ".join(one(j, v) for v in range(3)) + ")" for j in js) + ")"

    step = f"transform(array({post}), x -> named_struct('prior', ({total('p.n * p.q')} + 1D) / ({total('p.n')} + 2D), 'good', {shares('p.n * p.q', 0)}, 'bad', {shares('p.n * (1 - p.q)', 1)}))[0]"
    guess = lambda which: "array(" + ", ".join("array(" + ", ".join(f"{k[which][v]!r}D" for v in range(3)) + ")" for k in kinds) + ")"
    first = f"named_struct('prior', {PRIOR}D, 'good', {guess(0)}, 'bad', {guess(1)})"
    return f"transform(array(aggregate(sequence(1, {rounds}), {first}, (s, i) -> {step})), s -> {post})[0]"


def posteriors(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(votes, posterior) for each pattern in ``votes``; at most 3 ** rules rows, whatever the size of the corpus."""
    counts = votes.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = counts.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("pats"))
    fitted = one.select(F.explode(F.expr(em_expression(KINDS, rounds))).alias("p"))
    return fitted.select(F.col("p.votes").alias("votes"), F.col("p.q").alias("posterior"))


def decided(v: DataFrame, fitted: DataFrame) -> DataFrame:
    """voted rows with posterior and kept: base rules passed and posterior of good at least one half."""
    d = v.join(F.broadcast(fitted), "votes", "left")  # 3 ** 8 rows at most
    return d.withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= 0.5))


def annotated(docs: DataFrame) -> DataFrame:
    """docs with the columns of OWN. They are counted once: the rows go to the shared folder with them."""
    v = stored(voted(docs), "voted")
    return decided(v, stored(posteriors(v.select("votes")), "votes"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns only."""
    packed = docs.select(F.struct("*").alias("_row"), F.col("text"))  # whatever its columns are called
    v = stored(voted(packed).select("_row", "votes", "base_failed"), "voted")
    return decided(v, stored(posteriors(v.select("votes")), "votes")).where("kept").select("_row.*")
