"""URL filters: rules first, then logistic regression on hashed character n-grams.

The model is trained by numpy from the small labelled table below.  Character trigrams of
the host and of the path are hashed into separate halves of one weight table; weights are
kept as whole numbers, so sums do not depend on their order.  Each gram counts with one over
the root of the number of grams, in training and in scoring.  Parsing, rules and scoring
are DataFrame expressions.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict): the longest matching rule decides.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Labelled urls: 1 is to be blocked.
LABELLED = [
    ("http://docs.library.example/en/guide/42", 0), ("https://news.example.org/world/2021/story", 0), ("https://www.example.com/en/articles/7", 0),
    ("https://university.example.org/research/paper.html", 0), ("http://blog.example.com/posts/garden-notes", 0), ("https://wiki.example.org/fr/page/12", 0),
    ("https://m.example.com/es/help", 0), ("http://archive.example.org/texts/essay-9", 0), ("https://www.museum.example/collection/item/88", 0),
    ("https://shop.example.com/en/books/history", 0), ("https://example.com/about", 0), ("http://journal.example.org/volume/3/issue/2", 0),
    ("https://recipes.example.com/bread#steps", 0), ("https://forum.example.org/topic/114?page=2", 0), ("http://www.example.org/de/lexikon/haus", 0),
    ("https://data.example.org/tables/2020.csv", 0), ("http://casino-bonus.example.com/win/jackpot", 1), ("https://free-pills.example.org/buy/now", 1),
    ("http://xxx-videos.example.com/watch/1", 1), ("https://cheap-loans.example.org/apply?ref=spam", 1), ("http://bet365win.example.com/slots", 1),
    ("https://adult-chat.example.com/live/cams", 1), ("http://click-track.example.org/redirect?to=ad", 1), ("https://poker.example.com/free/spins", 1),
    ("http://download-crack.example.org/keygen.exe", 1), ("https://spam.example.com/ads/banner", 1), ("http://viagra-shop.example.org/order", 1),
    ("https://lottery-winner.example.com/claim/prize", 1), ("http://ads.example.com/popup/1", 1), ("https://torrent.example.org/warez/movie", 1),
    ("http://hot-singles.example.com/xxx/join", 1), ("https://escort.example.org/casino/vip", 1),
]
BUCKETS = 2048
_SCALE = 1 << 20


def _split(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[end:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


_LOWER = {a: a + 32 for a in range(65, 91)}


def gram_buckets(host: str, path: str) -> list[int]:
    """Buckets of the trigrams of the marked host, and of those of the marked path."""
    out = []
    for base, text in ((0, f"^{host}$"), (BUCKETS, f"^{path}$")):
        out += [base + (ord(a) * 961 + ord(b) * 31 + ord(c)) % BUCKETS for a, b, c in zip(text, text[1:], text[2:], strict=False)]
    return out


@lru_cache
def weights(steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> tuple[int, ...]:
    """Trained weights as whole numbers, one per bucket, and the bias last."""
    x = np.zeros((len(LABELLED), 2 * BUCKETS + 1))
    for i, (url, _) in enumerate(LABELLED):
        grams = gram_buckets(*_split(url))
        np.add.at(x[i], grams, 1 / np.sqrt(max(len(grams), 1)))
        x[i, -1] = 1
    y = np.array([label for _, label in LABELLED], float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) * 8 + ridge * w)
    return tuple(int(v) for v in np.round(w * _SCALE))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the first ``/``, ``?`` or ``#``; A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits, as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def model_score(host: Column, path: Column) -> Column:
    """Whole-number score; above zero is to be blocked."""
    w = weights()
    table = F.array(*(F.lit(v) for v in w[:-1]))

    def part(text: Column, base: int) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        code = lambda i: F.ascii(F.substr(marked, i, F.lit(1)))
        grams = F.when(F.length(marked) >= 3, F.sequence(F.lit(1), F.length(marked) - 2)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(grams, F.lit(0).cast("long"), lambda a, i: a + F.element_at(table, (F.pmod(code(i) * 961 + code(i + 1) * 31 + code(i + 2), F.lit(BUCKETS)) + base + 1).cast("int")))

    # training divides by the root of the number of grams; the sign only needs the bias multiplied instead
    grams = F.greatest(F.length(host) + F.length(path), F.lit(1))
    return part(host, 0) + part(path, BUCKETS) + (F.sqrt(grams.cast("double")) * w[-1]).cast("long")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """All input rows and columns, with host, path, rule and verdict (allow or block).

    ``pages`` needs url.  A null url, or one without ``://``, has an empty host and path,
    fits no rule and is judged by the model's bias (allowed).  Repeated rows are judged
    alike.  Input columns called like the added ones are replaced; an empty table gives an
    empty table.
    """
    pages = pages.select(*(f"`{c}`" for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}))
    url = F.col("url").cast("string")
    parsed = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parsed.withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, F.when(model_score(F.col("host"), F.col("path")) > 0, F.lit("block")).otherwise(F.lit("allow"))))


def oracle() -> str:
    """The same judgement over the table ``pages``, as DuckDB SQL."""
    w = weights()
    table = "[" + ",".join(map(str, w[:-1])) + "]"
    rules = sorted(RULES, key=lambda r: -(len(r[0]) + len(r[1])))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in rules]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    part = lambda c, base: f"list_sum(list_transform(generate_series(1, len({c}) - 2), lambda i: w[1 + {base} + (unicode({c}[i]) * 961 + unicode({c}[i + 1]) * 31 + unicode({c}[i + 2])) % {BUCKETS}]))"
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
),
s AS (
  SELECT *, '^' || host || '$' AS h, '^' || path || '$' AS q, {table}::BIGINT[] AS w FROM p
)
SELECT page_id, host, path, {case([h + p for h, p, _ in rules])} AS rule,
  coalesce({case([v for _, _, v in rules])},
    CASE WHEN coalesce({part("h", 0)}, 0) + coalesce({part("q", BUCKETS)}, 0) + CAST(trunc(sqrt(CAST(greatest(len(host) + len(path), 1) AS DOUBLE)) * {w[-1]}) AS BIGINT) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM s
"""
