"""Quality rules by weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the counts of the vote
patterns of documents that pass the base rules (at most 3 to the power of the number of rules, whatever the corpus)
estimates the share of good documents and how often each rule votes which way on good and on bad ones. The posterior
probability of "good" is the verdict. Nothing but the starting point is set by hand: it says that rules are better than
chance, and weighs as much as PSEUDO documents a class. What a bad vote counts for follows from how the rules agree.

Rules overlap (symbols, marks and word length; repeats, equal lines and varied words), so that agreement can be seen.

Null and empty texts have no words; all rules abstain on them. Repeated rows are judged alike. Extra columns pass
through. An empty table keeps the starting rates and gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WORD_GAP = r"[ \t-\r]+"
#: name, measure, limit that makes the vote good, limit that makes it bad; good lies on the side named.
RULES = (
    ("few_symbols", "symbol_rate", "below", 0.02, 0.10),
    ("mostly_letters", "mark_rate", "below", 0.07, 0.16),
    ("mostly_lower", "upper_rate", "below", 0.15, 0.30),
    ("few_repeats", "repeat_rate", "below", 0.10, 0.30),
    ("few_equal_lines", "dup_line_rate", "below", 0.05, 0.40),
    ("varied_words", "type_rate", "above", 0.50, 0.30),
    ("sentences_end", "end_rate", "above", 0.70, 0.35),
    ("usual_word_length", "length_gap", "below", 0.80, 2.50),
)
#: Rejected ids up to this number are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_REJECTED = 2_000_000
#: Starting share of good documents and chances of the votes -1, 0, 1 on good and on bad ones; their weight in documents.
START_GOOD, ON_GOOD, ON_BAD, PSEUDO = 0.8, (0.1, 0.2, 0.7), (0.5, 0.3, 0.2), 5.0
ROUNDS, SETTLED = 50, 1e-4


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words under 3-word windows that occur twice or more: windows are sorted by 64-bit hash and position, and neighbours of
    one hash count as equal when their words are."""
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))))

    def marked(s: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            out = a["h"] == b["h"]
            for k in range(3):
                out = out & (words[a["i"] + k] == words[b["i"] + k])
            return F.coalesce(out, F.lit(False))

        twins = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(twins, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(n >= 3, _let(windows, marked)).otherwise(0).cast("long")


def with_measures(docs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """Adds the counts of the contract and the rules' measures under `prefix`; rates of nothing are null."""
    p = lambda x: f"{prefix}{x}"
    c = lambda x: F.col(p(x))
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({p("words"): F.filter(F.split(text, WORD_GAP), lambda w: w != ""), p("lines"): F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))})
    out = out.withColumns({p("n_words"): F.size(c("words")).cast("long"), p("n_lines"): F.size(c("lines")).cast("long")})
    out = out.withColumns(
        {
            p("word_chars"): F.aggregate(c("words"), F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            p("n_symbols"): F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            p("n_upper"): F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
            p("n_marks"): F.regexp_count(text, F.lit(r"[!-@\[-`{-~]")).cast("long"),
            p("n_types"): F.size(F.array_distinct(c("words"))).cast("long"),
            p("n_dup_lines"): (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
            p("n_ends"): F.size(F.filter(c("lines"), lambda x: F.right(F.rtrim(x), F.lit(1)).isin(".", "!", "?"))).cast("long"),
            p("n_repeat_words"): _repeat_words(c("words"), F.size(c("words"))),
        }
    )
    rate = lambda a, b: F.try_divide(c(a).cast("double"), c(b).cast("double"))
    return out.withColumns(
        {
            p("symbol_rate"): rate("n_symbols", "n_words"),
            p("mark_rate"): rate("n_marks", "word_chars"),
            p("upper_rate"): rate("n_upper", "word_chars"),
            p("repeat_rate"): rate("n_repeat_words", "n_words"),
            p("dup_line_rate"): rate("n_dup_lines", "n_lines"),
            p("type_rate"): rate("n_types", "n_words"),
            p("end_rate"): rate("n_ends", "n_lines"),
            p("length_gap"): F.abs(rate("word_chars", "n_words") - 5.3),
        }
    ).drop(p("words"), p("lines"))


def votes(prefix: str = "_q_", rules=RULES) -> list[Column]:
    out = []
    for name, measure, side, good, bad in rules:
        x = F.col(f"{prefix}{measure}")
        up = x < good if side == "below" else x > good
        down = x > bad if side == "below" else x < bad
        out.append(F.when(up, 1).when(down, -1).otherwise(0).cast("int").alias(f"vote_{name}"))
    return out


def base_failed(prefix: str = "_q_") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (F.col(f"{prefix}n_repeat_words") * 100 > n * 50)


@dataclass
class Model:
    """The share of good documents and, by rule, the probabilities of the votes -1, 0, 1 on good and on bad ones."""

    prior: float = START_GOOD
    good: list[tuple[float, float, float]] = field(default_factory=lambda: [ON_GOOD] * len(RULES))
    bad: list[tuple[float, float, float]] = field(default_factory=lambda: [ON_BAD] * len(RULES))
    names: list[str] = field(default_factory=lambda: [r[0] for r in RULES])

    @classmethod
    def start(cls, names: list[str]) -> Model:
        return cls(START_GOOD, [ON_GOOD] * len(names), [ON_BAD] * len(names), names)

    def posterior(self) -> Column:
        """Probability of "good", from the columns vote_*."""
        gap = F.lit(math.log((1 - self.prior) / self.prior))
        for name, p, q in zip(self.names, self.good, self.bad, strict=True):
            low, none, high = (math.log(y / x) for x, y in zip(p, q, strict=True))
            v = F.col(f"vote_{name}")
            gap = gap + F.when(v < 0, low).when(v > 0, high).otherwise(none)
        return 1 / (1 + F.exp(F.least(gap, F.lit(300.0))))


def fit(patterns: DataFrame, names: list[str] | None = None, rounds: int = ROUNDS) -> Model:
    """EM over a table of vote patterns (columns vote_*, n). A round is one aggregation into one row of sums."""
    names = names or [r[0] for r in RULES]
    model = Model.start(names)
    wide = stored(patterns.select("n", *(f"vote_{x}" for x in names)).coalesce(1), "votes")  # 3 ** rules rows at most
    for _ in range(rounds):
        mass = {"good": F.col("n") * model.posterior(), "all": F.col("n").cast("double")}
        sums = [F.sum(m).alias(k) for k, m in mass.items()]
        sums += [F.sum(F.when(F.col(f"vote_{x}") == v, m)).alias(f"{k} {x} {v}") for k, m in mass.items() for x in names for v in (-1, 0, 1)]
        got = {k: v or 0.0 for k, v in wide.agg(*sums).first().asDict().items()}
        if not got["all"]:
            break

        def rates(x: str, start: tuple, share, total: float) -> tuple:
            return tuple((share(f" {x} {v}") + PSEUDO * s) / (total + PSEUDO) for v, s in zip((-1, 0, 1), start, strict=True))

        new = Model(
            (got["good"] + 1) / (got["all"] + 2),
            [rates(x, ON_GOOD, lambda k: got["good" + k], got["good"]) for x in names],
            [rates(x, ON_BAD, lambda k: max(0.0, got["all" + k] - got["good" + k]), max(0.0, got["all"] - got["good"])) for x in names],
            names,
        )
        moved = max(abs(p - q) for s, t in ((model.good, new.good), (model.bad, new.bad)) for i, j in zip(s, t, strict=True) for p, q in zip(i, j, strict=True))
        model = new
        if moved < SETTLED:
            break
    return model


def patterns(voted: DataFrame) -> DataFrame:
    return voted.groupBy(*(f"vote_{r[0]}" for r in RULES)).agg(F.count(F.lit(1)).alias("n"))


def votes_against_verdicts(judged: DataFrame) -> DataFrame:
    """n_bad, documents, kept_share of the documents that pass the base rules, by their number of bad votes."""
    bad = sum((F.col(f"vote_{r[0]}") == -1).cast("int") for r in RULES)
    return judged.filter(~F.col("base_failed")).groupBy(bad.alias("n_bad")).agg(F.count(F.lit(1)).alias("documents"), F.avg(F.col("kept").cast("int")).alias("kept_share"))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, counts, votes, posterior, base_failed, kept."""
    measured = with_measures(docs.select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    voted = stored(measured.select("doc_id", *(F.col(f"_q_{x}").alias(x) for x in counts), *votes(), base_failed().alias("base_failed")), "quality")
    model = fit(patterns(voted.filter(~F.col("base_failed"))))
    return voted.withColumn("posterior", model.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the rules keep, columns unchanged. Rows that share a doc_id stay if one of them is kept."""
    verdicts = judge(docs, threshold).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = stored(verdicts.filter("not kept").select(F.col("doc_id").alias("_q_id")), "rejected")
    few = gone.count() <= BROADCAST_REJECTED
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].eqNullSafe(gone["_q_id"]), "left_anti")
