"""Quality rules of documents, judged for whole hosts with shrunk failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
VISIBLE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: A host is rejected if a rule's shrunk failure rate exceeds that of the mean host by this,
MARGIN = 0.05
#: or if it exceeds this in any case.
LIMIT = 0.5

#: Name and condition of the rules that hosts are judged by.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _pairs(a: Column, combine) -> Column:
    """`combine` on each two neighbours of an array."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n), combine)


def measures(docs: DataFrame) -> DataFrame:
    """`doc_id, host` and counts over whole texts (null: empty).

    `n_repeat_words` counts the words inside a three-word window that occurs
    twice or more in its text. Windows are hashed, sorted within the row, and
    looked through for equal neighbours; rows without any are not sorted.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("host"),
        _without(text, " \t\n\u000b\f\r").cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(VISIBLE))).alias("lines"),
    )
    numbers = ["doc_id", "host", "word_chars", "n_symbols"]
    words = F.col("words")
    hashed = cut.select(
        *numbers,
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
            ),
        ).alias("windows"),
    )
    numbers += ["n_words", "n_lines", "n_dup_lines"]
    ordered = hashed.select(
        *numbers,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("windows"),
    )
    twice = _pairs(F.col("windows"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    found = ordered.select(
        *numbers, F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda p: p.isNotNull())))).alias("starts")
    )
    steps = _pairs(F.col("starts"), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(3), lambda total, step: total + step)
    return found.select(*numbers, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def host_verdicts(measured: DataFrame, margin: float = MARGIN) -> DataFrame:
    """`host, host_failed` and a shrunk failure rate `rate_<rule>` per rule, of every host that is not null.

    For each rule, the hosts' failure rates give a beta prior by their mean and
    variance, less the variance that drawing few documents explains. A host's
    rate is its posterior mean, so a small host needs more than a few failures.
    A host is rejected if a rate exceeds the mean host's by more than `margin`,
    or `LIMIT`.
    """
    failed = [F.sum(F.expr(rule).cast("long")).alias(name) for name, rule in RULES.items()]
    hosts = materialize(
        measured.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("docs"), *failed), "hosts"
    )
    moments = []
    for name in RULES:
        rate = F.col(name) / F.col("docs")
        moments += [F.avg(rate).alias(f"m_{name}"), F.var_pop(rate).alias(f"v_{name}")]
    m = hosts.agg(F.avg(1 / F.col("docs")).alias("few"), *moments).first()
    rejected, rates = F.lit(False), []
    for name in RULES:
        mean, variance = m[f"m_{name}"] or 0.0, m[f"v_{name}"] or 0.0  # null without hosts
        drawn = mean * (1 - mean) * (m.few or 0.0)
        spread = max(variance - drawn, 1e-9)
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)
        rate = (F.col(name) + mean * strength) / (F.col("docs") + strength)
        rejected = rejected | (rate > min(mean + margin, LIMIT))
        rates.append(rate.alias(f"rate_{name}"))
    return hosts.select("host", rejected.alias("host_failed"), *rates)


def judge(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """`doc_id`, the counts, `base_failed`, `host_failed`, `kept` and the host's shrunk rates of each row of
    `doc_id, text, source`.

    A document fails by itself if it has under 50 words, or over half of its
    words repeat. It is kept if it does not fail and its host is not rejected
    (see `host_verdicts`). A document without a host is judged by itself only
    and has null rates. Repeated rows count each.
    """
    measured = materialize(measures(docs), "measures")
    base = F.expr(f"{RULES['short']} OR {RULES['repetitive']}")
    return (
        measured.join(host_verdicts(measured, margin), "host", "left")
        .withColumn("base_failed", base)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            F.coalesce("host_failed", F.lit(False)).alias("host_failed"),
            (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
            *[F.round(f"rate_{name}", 6).alias(f"rate_{name}") for name in RULES],
        )
    )
