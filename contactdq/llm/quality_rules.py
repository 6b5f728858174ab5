"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one failure bit for each rule;
policies are versioned sets of rejecting bits applied to the ledger later, and ablations are bitwise aggregations
over it, so neither reads a text again. All of it is column expressions; nothing is shuffled before the ablation
counts, which are one partial sum for each task.

Edge cases: a null, empty or blank text measures zero everywhere and fails ``few_words``. Repeated rows are judged
row by row. A null id is carried through. An empty table gives an empty ledger. Input columns other than the id and
the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactdq.functions.barrier import settled
from contactdq.llm.common import SPACE_CLASS, spaced_words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A named test over the measurements; its place in the rule list is its bit."""

    name: str
    fails: Column | str


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject a document."""

    version: str
    rejecting: tuple[str, ...]


#: Integer arithmetic only, so every engine decides alike.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("shouting", "n_letters > 0 AND 100 * n_upper > 60 * n_letters"),
)

POLICIES = {
    "base-1": Policy("base-1", ("few_words", "repeated_windows")),
    "strict-1": Policy("strict-1", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "shouting")),
}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the measurements of every document, each computed once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), text.alias("_text"), spaced_words(F.col(text_col)).alias("_w"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select(
        id_col,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", f"[{SPACE_CLASS}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]+", ""))).cast("long").alias("n_upper"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[A-Za-z]+", ""))).cast("long").alias("n_letters"),
    )
    # A window's hash repeats whenever the window does, so a text without a repeated hash has no repeated window.
    hashes = F.expr("CASE WHEN n_words < 4 THEN array() ELSE transform(sequence(0, int(n_words) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END").cast("array<bigint>")
    base = base.withColumns({"_h": hashes, "n_lines": F.size("_l").cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")})
    # Else windows are told apart by two hashes, of their words in both orders.
    sorted_windows = F.expr(
        "CASE WHEN size(array_distinct(_h)) = size(_h) THEN array() ELSE array_sort(transform(_h, (h, i) -> struct(h AS h, xxhash64('b', _w[i + 2], _w[i + 1], _w[i]) AS b, i AS pos))) END"
    ).cast("array<struct<h:bigint,b:bigint,pos:int>>")
    base = base.withColumn("_s", sorted_windows)
    repeated = F.expr("filter(_s, (x, i) -> (i > 0 AND _s[i - 1].h = x.h AND _s[i - 1].b = x.b) OR (i + 1 < size(_s) AND _s[i + 1].h = x.h AND _s[i + 1].b = x.b)).pos")
    base = base.withColumn("_r", F.array_sort(repeated))
    # Each repeated window covers three words; a word that the previous repeated window covers counts once.
    covered = F.expr("aggregate(transform(_r, (p, i) -> CASE WHEN i = 0 THEN 3 ELSE least(3, p - _r[i - 1]) END), 0, (s, x) -> s + x)")
    return settled(base.withColumn("n_repeat_words", covered.cast("long")).select(id_col, *MEASURES), *MEASURES)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``failed_bits``: bit k is set where rule k fails."""
    bits = None
    for k, rule in enumerate(rules):
        test = F.expr(rule.fails) if isinstance(rule.fails, str) else rule.fails
        bit = F.when(F.coalesce(test, F.lit(False)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured(docs, id_col, text_col).withColumn("failed_bits", bits if bits is not None else F.lit(0).cast("long"))


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    """The bits that reject under a policy; an unknown rule name is an error."""
    place = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << place[name] for name in set(policy.rejecting))


def apply_policy(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``policy_version`` and ``kept``."""
    return book.withColumns({"policy_version": F.lit(policy.version), "kept": F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0})


def ablation(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each rule: documents it fails, documents that only it rejects under the policy, and documents kept without it."""
    full = mask(policy, rules)
    bits = F.col("failed_bits").bitwiseAND(F.lit(full).cast("long"))
    sums = [F.count("*").alias("n_docs")]
    for k, rule in enumerate(rules):
        one = 1 << k
        sums += [
            F.count_if(F.col("failed_bits").bitwiseAND(F.lit(one).cast("long")) != 0).alias(f"failed_{k}"),
            F.count_if(bits == one).alias(f"alone_{k}"),
            F.count_if(bits.bitwiseAND(F.lit(full & ~one).cast("long")) == 0).alias(f"kept_{k}"),
        ]
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(k).alias("bit"), F.col(f"failed_{k}").alias("n_failed"), F.col(f"alone_{k}").alias("n_failed_alone"), F.col(f"kept_{k}").alias("n_kept_without")) for k, r in enumerate(rules)]
    return book.agg(*sums).select(F.lit(policy.version).alias("policy_version"), "n_docs", F.inline(F.array(*rows)))


def filter_documents(docs: DataFrame, policy: Policy = POLICIES["strict-1"], id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns only.

    The measurements ride along with the row itself, so nothing is joined back and repeated or null ids are safe.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_t"))
    book = ledger(packed.withColumnRenamed("_row", "_id"), "_id", "_t", rules)
    return apply_policy(book, policy, rules).filter("kept").select("_id.*")
