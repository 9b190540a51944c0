"""Quality by weak supervision: rules vote good, vote bad or abstain; expectation-maximisation weighs them.

The votes of a document are packed into one number. Counting the distinct patterns of all documents is the only
aggregation, and the patterns are at most 3 to the number of rules, whatever the corpus; EM runs on their counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

ABSTAIN, GOOD, BAD = 0, 1, 2
ITERATIONS, KEEP_AT = 60, 0.5


def _facts(text: Column) -> Column:
    """What the rules look at, computed in one projection."""
    filled = lambda parts: F.filter(parts, lambda x: F.trim(x) != "")
    return F.struct(
        F.length(text).alias("chars"), filled(F.split(text, r"\s+")).alias("words"), filled(F.split(text, r"\n")).alias("lines"),
        F.regexp_count(text, F.lit(r"[|#$%&*<>{}\\^~!=_]")).alias("clutter"), F.regexp_count(text, F.lit(r"\p{Lu}")).alias("capitals"),
        F.regexp_count(text, F.lit("[0-9]")).alias("digits"), F.regexp_count(text, F.lit("[.,;:?]")).alias("stops"),
    )


def _measures(f: Column) -> Column:
    n = F.size(f.words)
    words, lines, chars = F.greatest(n, F.lit(1)), F.greatest(F.size(f.lines), F.lit(1)), F.greatest(f.chars, F.lit(1))
    repeats = F.aggregate(f.words, F.struct(F.lit("").alias("last"), F.lit(0).alias("n")), lambda a, w: F.struct(w.alias("last"), (a.n + (a.last == w).cast("int")).alias("n"))).n
    return F.struct(
        f.chars.alias("chars"), n.alias("n"), F.size(f.lines).alias("lines"), (F.size(F.array_distinct(f.lines)) / lines).alias("fresh_lines"),
        (F.size(F.array_distinct(f.words)) / words).alias("variety"), (repeats / words).alias("repeats"), (f.clutter / words).alias("clutter"),
        (f.digits / chars).alias("digits"), (f.stops / words).alias("stops"), (f.capitals / chars).alias("capitals"), (f.chars / words).alias("word_chars"),
    )


#: ``(name, bad, good)``: conditions over the measures ``m``; neither holds where the rule abstains. Rules that look
#: for one kind of junk only vote bad: that a text is no table says little about whether it is good.
RULES = (
    ("length", lambda m: (m.n < 12) | (m.chars < 80), lambda m: m.n >= 50),
    ("clutter", lambda m: m.clutter > 0.3, lambda m: m.clutter < 0.05),
    ("punctuation", lambda m: (m.n >= 20) & ((m.stops < 0.03) | (m.stops > 0.6)), lambda m: m.stops.between(0.05, 0.4)),
    ("variety", lambda m: (m.n >= 20) & (m.variety < 0.2), None),
    ("adjacent_repeats", lambda m: m.repeats > 0.2, None),
    ("shouting", lambda m: m.capitals > 0.25, None),
    ("heavy_clutter", lambda m: m.clutter > 0.4, None),
    ("digits", lambda m: m.digits > 0.25, None),
    ("repeated_lines", lambda m: (m.fresh_lines < 0.5) & (m.lines >= 4), None),
    ("word_length", lambda m: (m.word_chars > 14) | (m.word_chars < 2.5), None),
)


def pattern(text: Column, rules=RULES) -> Column:
    """Votes of all rules as base-3 digits, the first rule's digit lowest; a null text counts as an empty one."""
    one = lambda column, of: F.element_at(F.transform(F.array(column), of), 1)

    def votes(m):
        code = F.lit(0)
        for k, (_, bad, good) in enumerate(rules):
            vote = F.when(bad(m), BAD * 3**k)
            code = code + (vote.when(good(m), GOOD * 3**k) if good else vote).otherwise(0)
        return code.cast("int")

    return one(_facts(F.coalesce(text, F.lit(""))), lambda f: one(_measures(f), votes))


def votes_of(pattern: np.ndarray, rules: int) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(rules)) % 3


def fit(patterns: np.ndarray, counts: np.ndarray, rules: int, iterations: int = ITERATIONS, prior: float = 0.05) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, ``P(vote | class)`` as ``[rule, class, vote]`` (class 1 is good), posteriors of the patterns.

    EM of the naive Bayes mixture over the votes. ``prior`` times the number of documents are added to the counts as
    if they had voted as rules are believed to: bad votes rare among good documents, far more common among bad ones.
    That names the two classes; the rest is learned.
    """
    votes = votes_of(patterns, rules)
    good = 0.8
    believed = np.array([[0.45, 0.2, 0.35], [0.295, 0.7, 0.005]])
    table = np.repeat(believed[None], rules, 0)
    posterior = np.zeros(len(patterns))
    for _ in range(iterations if len(patterns) else 0):
        scores = np.log([1 - good, good]) + np.log(table[np.arange(rules)[None, :], :, votes]).sum(1)
        posterior = 1 / (1 + np.exp(np.clip(scores[:, 0] - scores[:, 1], -700, 700)))
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        for v in range(3):
            table[:, :, v] = (weight @ (votes == v)).T
        table += believed * (1 + prior * counts.sum())
        table /= table.sum(2, keepdims=True)
        good = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
    return good, table, posterior


def assess(docs: DataFrame, text: str = "text", rules=RULES, iterations: int = ITERATIONS, posterior: str = "posterior", columns: list[str] | None = None) -> DataFrame:
    """``docs``, or its named ``columns``, with the posterior probability that each row is good.

    The rules see whole texts, of any length; a null text is judged as an empty one, equal texts and repeated rows get
    equal posteriors, an empty table gives none. An existing column of that name is kept: the new one gets underscores
    behind its name. The rules run once: the rows are stored with their pattern, which is then looked up.
    """
    columns = docs.columns if columns is None else columns
    column, p = free_name(docs, posterior), free_name(docs, "p")
    voted = stored(docs.select(*(F.col(f"`{c}`") for c in columns), pattern(F.col(f"`{text}`"), rules).alias(p)))
    seen = voted.groupBy(F.col(p).alias("p")).count().toPandas().sort_values("p")
    _, _, probability = fit(seen.p.to_numpy(np.int64), seen["count"].to_numpy(np.float64), len(rules), iterations)
    # At most 3 ** rules rows: a literal map would be searched in line, so it is a broadcast table.
    known = docs.sparkSession.createDataFrame([(int(a), float(b)) for a, b in zip(seen.p, probability)], f"`{p}` int, `{column}` double")
    return voted.join(F.broadcast(known), p, "left").select(*(F.col(f"`{c}`") for c in columns), column)


def keep(docs: DataFrame, at: float = KEEP_AT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose posterior is ``at`` or more, with their columns only."""
    column = free_name(docs, "posterior")
    return assess(docs, text).where(F.col(column) >= at).select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle(columns: str = "doc_id", at: float = KEEP_AT, iterations: int = ITERATIONS, prior: float = 0.05) -> str:
    """DuckDB SQL of the rows that ``keep`` keeps with their posterior to six places: the same votes from the texts, and
    EM as a recursive query over the counted patterns, whose state is one row of two lists of probabilities."""
    n = len(RULES)
    code = " + ".join(f"CASE WHEN {bad} THEN {2 * 3**k} WHEN {good} THEN {3**k} ELSE 0 END" for k, (bad, good) in enumerate(_SQL_RULES))
    believed = {"b": (0.45, 0.2, 0.35), "g": (0.295, 0.7, 0.005)}
    start = {c: "[" + ", ".join(f"{v}e0" for _ in range(n) for v in row) + "]" for c, row in believed.items()}
    joint = {c: f"list_sum(list_transform(range({n}), lambda r: ln(t{c}[3 * r + x.v[r + 1] + 1])))" for c in "bg"}
    cells = lambda c, w: f"list_transform(range({3 * n}), lambda k: list_sum(list_transform(range(1, len(pats) + 1), lambda j: CASE WHEN pats[j].v[k // 3 + 1] = k % 3 THEN {w} ELSE 0e0 END)) + {start[c]}[k + 1] * (1 + {prior}e0 * total))"
    norm = lambda t: f"list_transform(range({3 * n}), lambda k: {t}[k + 1] / ({t}[k - k % 3 + 1] + {t}[k - k % 3 + 2] + {t}[k - k % 3 + 3]))"
    return f"""
    WITH RECURSIVE f AS (SELECT *, coalesce(text, '') AS s FROM documents),
    w AS (SELECT *, length(s) AS chars, list_filter(string_split_regex(s, '[ \t\n\x0B\f\r]+'), lambda x: trim(x) <> '') AS words, list_filter(string_split(s, chr(10)), lambda x: trim(x) <> '') AS lines FROM f),
    c AS (SELECT *, len(words) AS n, greatest(len(words), 1) AS d, greatest(len(lines), 1) AS l, greatest(chars, 1) AS h,
        len(regexp_extract_all(s, '[|#$%&*<>{{}}\\^~!=_]')) AS clutter, len(regexp_extract_all(s, '\\p{{Lu}}')) AS capitals, len(regexp_extract_all(s, '[0-9]')) AS digits, len(regexp_extract_all(s, '[.,;:?]')) AS stops,
        len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS again FROM w),
    p AS (SELECT *, {code} AS p FROM c),
    k AS (SELECT p, count(*)::DOUBLE AS m, list_transform(range({n}), lambda r: (p // (3 ** r)::BIGINT) % 3) AS v FROM p GROUP BY p),
    a AS (SELECT list({{'p': p, 'm': m, 'v': v}} ORDER BY p) AS pats, sum(m) AS total FROM k),
    em AS (SELECT 0 AS i, pats, total, 0.8e0 AS good, {start["b"]} AS tb, {start["g"]} AS tg, list_transform(pats, lambda x: 0e0) AS post FROM a
        UNION ALL SELECT i + 1, pats, total, greatest(0.01e0, least(0.99e0, (list_sum(list_transform(range(1, len(pats) + 1), lambda j: post[j] * pats[j].m)) + 1) / (total + 2))), {norm("ub")}, {norm("ug")}, post
        FROM (SELECT *, {cells("b", "(1 - post[j]) * pats[j].m")} AS ub, {cells("g", "post[j] * pats[j].m")} AS ug
            FROM (SELECT i, pats, total, good, tb, tg, list_transform(pats, lambda x: 1 / (1 + exp(greatest(-700, least(700, ln(1 - good) + {joint["b"]} - ln(good) - {joint["g"]}))))) AS post FROM em WHERE i < {iterations}))),
    q AS (SELECT unnest(pats).p AS p, unnest(post) AS q FROM em WHERE i = {iterations})
    SELECT {columns}, floor(q * 1e6 + 0.5) / 1e6 AS posterior FROM p JOIN q USING (p) WHERE q >= {at}"""


#: The rules in SQL, over the columns of ``oracle``.
_SQL_RULES = (
    ("n < 12 OR chars < 80", "n >= 50"), ("clutter / d > 0.3e0", "clutter / d < 0.05e0"), ("n >= 20 AND (stops / d < 0.03e0 OR stops / d > 0.6e0)", "stops / d BETWEEN 0.05e0 AND 0.4e0"),
    ("n >= 20 AND len(list_distinct(words)) / d < 0.2e0", "false"), ("again / d > 0.2e0", "false"), ("capitals / h > 0.25e0", "false"), ("clutter / d > 0.4e0", "false"), ("digits / h > 0.25e0", "false"),
    ("len(lines) >= 4 AND len(list_distinct(lines)) / l < 0.5e0", "false"), ("chars / d > 14 OR chars / d < 2.5e0", "false"),
)
