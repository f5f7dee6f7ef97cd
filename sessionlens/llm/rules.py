"""Quality rules as a bitmask ledger (operator 3).

Every text is measured once and every rule evaluated once; the ledger keeps the measurements and one failure bit
per rule. A policy is a named, versioned set of rules with the number of failures it allows: verdicts under any
policy, and what each rule alone is responsible for (its ablation), come from the bits, without the texts.

Built from SQL functions only. Windows of words are compared by 64-bit hashes within one text: the hashes are
packed with their positions, sorted as plain numbers, and neighbours compared, so the time stays n log n also
for a text that repeats itself from end to end.

Cases: a null or empty text has no words and fails ``few_words``; repeated rows get equal ledgers; an empty table
gives an empty ledger; columns named like a measurement are replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import SPACE, let

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_adjacent"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more in the text."""

    def by_hashes(keys: Column) -> Column:
        """Positions of the keys that occur more than once, ascending."""
        # the low bits of a sort key hold the position, the high bits the hash
        bits = F.length(F.bin(F.size(keys)))
        low_bits = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def sort(low: Column) -> Column:
            packed = F.sort_array(F.transform(keys, lambda k, i: k.bitwiseOR(low).bitwiseXOR(low).bitwiseOR(i.cast("long"))))
            return let(packed, lambda order: mark(order, low))

        def mark(order: Column, low: Column) -> Column:
            place = lambda x: x.bitwiseAND(low).cast("int")
            key = lambda j: F.get(keys, place(F.get(order, j)))
            head = lambda j: F.get(order, j).bitwiseOR(low)
            # equal high bits with different hashes: neighbours no longer tell, so hashes are compared one by one
            clash = F.exists(F.sequence(F.lit(1), F.size(order) - 1), lambda j: (head(j) == head(j - 1)) & (key(j) != key(j - 1)))
            near = F.filter(order, lambda x, j: F.coalesce(head(j) == head(j - 1), F.lit(False)) | F.coalesce(head(j) == head(j + 1), F.lit(False)))
            alike = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: F.size(F.filter(keys, lambda k: k == F.get(keys, i))) > 1)
            return F.sort_array(F.when((F.size(order) > 1) & clash, alike).otherwise(F.transform(near, place)))

        return let(low_bits, sort)

    def covered(starts: Column) -> Column:
        step = lambda s, p: F.struct(
            (s["n"] + F.least(F.lit(window), p + window - s["end"])).alias("n"), (p + window).alias("end")
        )
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"])

    def count(own: Column) -> Column:
        keys = F.transform(
            F.sequence(F.lit(0), F.size(own) - window),
            lambda i: F.xxhash64(*(F.get(own, i + k) for k in range(window))),
        )
        return let(keys, lambda k: let(by_hashes(k), covered))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashed, count)).cast("long")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements of every whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    without = lambda pattern: F.length(F.regexp_replace(whole, pattern, ""))
    lines = lambda: F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long").alias("n_adjacent"),
        )

    def of_lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    out = (
        df.withColumn("_words", let(words_of(whole), of_words))
        .withColumn("_lines", let(lines(), of_lines))
        .withColumn("n_symbols", (F.length(whole) - without(r"[#*$%&|<>]+")).cast("long"))
        .withColumn("n_marks", (F.length(whole) - without(r"!!+")).cast("long"))
        .withColumn("n_upper", (F.length(whole) - without(r"\p{Lu}+")).cast("long"))
        .withColumn("n_letters", F.col("_words.word_chars"))
    )
    for name in ("n_words", "word_chars", "n_repeat_words", "n_adjacent"):
        out = out.withColumn(name, F.col(f"_words.{name}"))
    for name in ("n_lines", "n_dup_lines"):
        out = out.withColumn(name, F.col(f"_lines.{name}"))
    return out.drop("_words", "_lines")


@dataclass(frozen=True)
class Rule:
    """A text fails if ``fails`` (SQL over the measurements) holds."""

    name: str
    fails: str


#: The place of a rule in this list is its bit, so rules are only ever added at the end.
RULES = [
    Rule("few_words", "n_words < 10"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "n_words > 0 and 100 * n_symbols > 10 * n_words"),
    Rule("shouting", "100 * n_upper > 50 * n_letters"),
    Rule("marks", "100 * n_marks > 40 * n_words"),
    Rule("same_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("stutter", "100 * n_adjacent > 30 * n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
]
BASE = ("few_words", "repeats")


@dataclass(frozen=True)
class Policy:
    """Rejects a text with more than ``allowed`` failures among ``rules``."""

    name: str
    version: int
    rules: tuple[str, ...]
    allowed: int = 0

    def mask(self, rules: list[Rule]) -> int:
        at = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << at[name] for name in self.rules)


STRICT = Policy("strict", 1, tuple(r.name for r in RULES))


def ledger(df: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """Adds the measurements and ``failed``, the bits of the rules that a text fails."""
    rules = RULES if rules is None else rules
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(df, text).withColumn("failed", bits)


def verdict(policy: Policy, rules: list[Rule] | None = None, failed: str = "failed") -> Column:
    """True for the rows of a ledger that the policy keeps."""
    return F.bit_count(F.col(failed).bitwiseAND(F.lit(policy.mask(RULES if rules is None else rules)))) <= policy.allowed


def ablation(book: DataFrame, policy: Policy, rules: list[Rule] | None = None) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows rejected, and rows that only it rejects.

    Rows are counted per pattern of bits first; the rest works on the patterns.
    """
    rules = RULES if rules is None else rules
    mask, at = policy.mask(rules), {r.name: i for i, r in enumerate(rules)}
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = patterns.withColumn("rule", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(1 << at[n]).cast("long").alias("bit")) for n in policy.rules))))
    rejected = F.bit_count("bits") > policy.allowed
    without = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("rule.bit")))) > policy.allowed
    return each.groupBy(F.col("rule.name").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("rule.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(rejected, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(rejected & ~without, F.col("n")).otherwise(0)).alias("only_by_it"),
    )
