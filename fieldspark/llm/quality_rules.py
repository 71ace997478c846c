"""Quality rules: a threshold table compiled into one projection.

Edge cases: a null or empty text has no words and fails the base rule; a ratio over zero words or lines is 0; repeated
rows are judged one by one; other columns pass through `judge` untouched, and its own output columns replace columns of
the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import NOT_SPACE, let

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that",
    "the", "this", "to", "was", "with", "au", "aux", "ce", "dans", "de", "des", "elle", "en", "est", "et", "la",
    "le", "les", "ne", "pas", "pour", "que", "qui", "sur", "un", "une", "auf", "das", "dem", "den", "der", "die",
    "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu", "al", "con", "del", "el", "las",
    "lo", "los", "no", "para", "por", "se", "su", "una", "y",
)

#: A word's place in its text takes the low bits of a sort key, its window's hash the rest.
PLACE_BITS = 28


@dataclass(frozen=True)
class Rule:
    """A text is kept if low <= metric <= high."""

    name: str
    metric: str
    low: float = float("-inf")
    high: float = float("inf")


RULES = (
    Rule("word_count", "n_words", 50, 1_000_000),
    Rule("word_length", "mean_word_length", 2.5, 12),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_word_ratio", low=0.06),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.3),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9),
    Rule("capitals", "capital_ratio", high=0.5),
)


COUNTS = (
    "n_words", "word_chars", "n_repeat_words", "n_stop_words", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines",
    "n_symbols", "n_capitals",
)
RATIOS = (
    "mean_word_length", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "ellipsis_line_ratio", "bullet_line_ratio", "capital_ratio",
)


def _repeated_places(words: Column) -> Column:
    """How many words stand in a three-word window that the text holds twice or more.

    Keys of (some bits of the window's hash, place) are sorted, so equal windows are neighbours unless another window
    with the same bits lies between them.  Where neighbours with the same bits have other words, which few texts have,
    the windows are sorted by their words instead; so a collision neither adds nor hides a repeat.  The windows' places
    are merged into a count of covered words."""
    mask = F.lit((1 << PLACE_BITS) - 1).cast("long")

    def key(i):
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long"))

    place = lambda k: k.bitwiseAND(mask).cast("int")

    def same_words(i, j):
        alike = F.lit(True)
        for d in range(3):
            alike = alike & (F.get(words, i + d) == F.get(words, j + d))
        return alike

    def covered(places):
        gaps = F.transform(places, lambda p, k: F.coalesce(F.least(F.get(places, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(keys, found, of):
        """Places of the windows with these indices, which equal the one before, and of those before."""
        at = F.concat(found, F.transform(found, lambda k: k - 1))
        return F.array_sort(F.array_distinct(F.transform(at, lambda k: of(F.get(keys, k)))))

    # The last index twice for one key alone: nothing equals itself here, as index 0 has no neighbour before it.
    neighbours = lambda keys, test: F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(keys) - 1, F.lit(1))), lambda k: test(F.get(keys, k), F.get(keys, k - 1))
    )

    def by_words(starts):
        triples = F.sort_array(F.transform(starts, lambda i: F.struct(*[F.get(words, i + d).alias(f"w{d}") for d in range(3)], i.alias("i"))))

        def count(keys):
            equal = lambda a, b: (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"])
            return let(neighbours(keys, equal), lambda found: let(places(keys, found, lambda k: k["i"]), covered))

        return let(triples, count)

    def count(keys):
        near = neighbours(keys, lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS))

        def confirmed(near):
            hits = F.filter(near, lambda k: same_words(place(F.get(keys, k)), place(F.get(keys, k - 1))))
            return let(
                hits,
                lambda found: F.when(F.size(found) < F.size(near), by_words(F.sequence(F.lit(0), F.size(words) - 3)))
                .when(F.size(found) > 0, let(places(keys, found, place), covered)),
            )

        return F.coalesce(let(near, confirmed), F.lit(0).cast("long"))

    keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), key))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(keys, count))


def metrics(text: str = "text") -> dict[str, Column]:
    """Counts and ratios of one text column; every one is a plain expression."""
    whole = F.coalesce(F.col(text), F.lit(""))
    long = lambda c: c.cast("long")
    words = F.regexp_extract_all(whole, F.lit(NOT_SPACE), F.lit(0))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.rlike(x, F.lit(NOT_SPACE)))

    def of_words(w):
        return F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.length(F.array_join(w, ""))).alias("word_chars"),
            _repeated_places(w).alias("n_repeat_words"),
            long(F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS)))).alias("n_stop_words"),
        )

    def of_lines(x):
        return F.struct(
            long(F.size(x)).alias("n_lines"),
            long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            long(F.size(F.filter(x, lambda s: F.rlike(s, F.lit(r"(\.\.\.|…)\s*$"))))).alias("n_ellipsis_lines"),
            long(F.size(F.filter(x, lambda s: F.rlike(s, F.lit(r"^\s*[-*•‣·]\s"))))).alias("n_bullet_lines"),
        )

    without = lambda pattern: F.length(F.regexp_replace(whole, pattern, ""))
    return {
        "w": let(words, of_words),
        "l": let(lines, of_lines),
        "n_symbols": long(F.length(whole) - without(r"[#*$%&|<>]+")),
        "n_capitals": long(F.length(whole) - without(r"\p{Lu}+")),
    }


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def verdict(rules: tuple[Rule, ...] = RULES, text: str = "text") -> Column:
    """One struct of counts, ratios, broken rules, base_failed and kept.

    All of it is one expression whose parts are worked out once, so a filter on one of its fields that Spark moves
    below the projection takes one evaluation with it and not one for each use of a count."""
    found = metrics(text)

    def counts(m):
        fields = {k: m["w"][k] for k in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")}
        fields |= {k: m["l"][k] for k in ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")}
        return F.struct(*[c.alias(k) for k, c in fields.items()], m["n_symbols"].alias("n_symbols"), m["n_capitals"].alias("n_capitals"))

    def with_ratios(c):
        ratios = {
            "mean_word_length": _share(c["word_chars"], c["n_words"]),
            "symbol_ratio": _share(c["n_symbols"], c["n_words"]),
            "stop_word_ratio": _share(c["n_stop_words"], c["n_words"]),
            "dup_line_ratio": _share(c["n_dup_lines"], c["n_lines"]),
            "ellipsis_line_ratio": _share(c["n_ellipsis_lines"], c["n_lines"]),
            "bullet_line_ratio": _share(c["n_bullet_lines"], c["n_lines"]),
            "capital_ratio": _share(c["n_capitals"], c["word_chars"]),
        }
        return F.struct(*[c[k].alias(k) for k in COUNTS], *[r.alias(k) for k, r in ratios.items()])

    def judged(r):
        broken = F.array_compact(F.array(*[F.when(~r[x.metric].between(x.low, x.high), F.lit(x.name)) for x in rules]))
        base = (r["n_words"] < 50) | (100 * r["n_repeat_words"] > 50 * r["n_words"])

        def with_verdict(b):
            own = [r[k].alias(k) for k in (*COUNTS, *RATIOS)]
            return F.struct(
                *own, b["broken"].alias("broken_rules"), b["base"].alias("base_failed"),
                (~b["base"] & (F.size(b["broken"]) == 0)).alias("kept"),
            )

        return let(F.struct(broken.alias("broken"), base.alias("base")), with_verdict)

    whole = F.struct(*[c.alias(k) for k, c in found.items()])
    return let(whole, lambda m: let(counts(m), lambda c: let(with_ratios(c), judged)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every row with its counts, ratios, the names of the rules it breaks, base_failed and kept."""
    name = "verdict"
    while name in docs.columns:
        name += "_"
    found = docs.withColumn(name, verdict(rules, text))
    fields = (*COUNTS, *RATIOS, "broken_rules", "base_failed", "kept")
    return found.withColumns({k: F.col(f"{name}.{k}") for k in fields}).drop(name)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass, with their own columns.  One filter, no shuffle."""
    return docs.filter(verdict(rules, text)["kept"])


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same judgement as DuckDB SQL over documents."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)

    def bounds(r):
        low = f"{r.metric} >= {r.low}" if r.low > float("-inf") else "TRUE"
        high = f"{r.metric} <= {r.high}" if r.high < float("inf") else "TRUE"
        return f"({low} AND {high})"

    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, r, t, regexp_extract_all(t, '{NOT_SPACE}') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) AS ls FROM d),
win AS (SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      len(list_filter(ws, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines,
      len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_ellipsis_lines,
      len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*•‣·]\\s'))) AS n_bullet_lines,
      length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN cov USING (r)),
q AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length,
      coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
      coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_word_ratio,
      coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
      coalesce(n_ellipsis_lines / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
      coalesce(n_bullet_lines / nullif(n_lines, 0), 0) AS bullet_line_ratio,
      coalesce(n_capitals / nullif(word_chars, 0), 0) AS capital_ratio,
      n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(map(bounds, rules))} AS kept
FROM q"""
