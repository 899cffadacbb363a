"""URL filter: host/path rules first, then a weighted vocabulary.

The vocabulary is matched with one Aho-Corasick automaton per task: a term
counts only when neither neighbour is a letter or digit. One strict term
rejects the url; soft terms reject when at least ``soft_distinct`` different ones
are found and their weights reach ``soft_limit``. A term that is listed as both is
strict. Larger vocabularies come as a table (``read_vocabulary``).

Of the rules that fit the longest wins, of equally long ones the first listed.

Nulls and edge cases: a null url, or one without ``://``, has empty host and
path, fits no rule and (being judged as its own text, null as empty) is
normally allowed. Repeated rows are judged one by one. Only ``id_col`` and
``url_col`` are read, so other columns cannot clash. Every row is judged by
itself: no shuffle, and no key can become hot.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pizarra.llm.common import ascii_lower, table

# Default vocabulary, in English, Spanish, German and French: parameters of the operator.
STRICT = (
    "adult", "casino", "casinos", "camgirls", "erotic", "erotica", "erotico", "erotik", "erotique", "escort", "escorts", "hentai", "hotsex",
    "nude", "nudes", "porn", "porno", "pornografia", "pornographie", "poker", "putas", "sex", "sexe", "sexo", "sexshop", "viagra", "cialis",
    "webcamsex", "xxx", "warez", "keygen", "ruleta", "tragaperras", "spielbank", "gluecksspiel",
)
SOFT = {
    "ads": 1, "adserver": 2, "affiliate": 2, "anuncios": 1, "annonces": 1, "banner": 1, "bet": 1, "bets": 1, "bonus": 1, "cheap": 1, "click": 1,
    "clickbait": 2, "coupon": 1, "coupons": 1, "credit": 1, "credito": 1, "crypto": 1, "deal": 1, "deals": 1, "discount": 1, "descuento": 1,
    "download": 1, "descargar": 1, "free": 1, "freebie": 2, "gagner": 1, "ganar": 1, "gewinn": 1, "gewinnspiel": 2, "giveaway": 2, "gratis": 1,
    "gratuit": 1, "jackpot": 2, "kostenlos": 1, "kredit": 1, "loan": 1, "loans": 1, "lottery": 2, "loterie": 2, "loteria": 2, "oferta": 1,
    "offer": 1, "offers": 1, "popup": 1, "popunder": 2, "premio": 1, "prestamo": 1, "pret": 1, "promo": 1, "promocion": 1, "promotion": 1,
    "rabatt": 1, "referral": 1, "remise": 1, "sorteo": 1, "spam": 2, "sponsored": 1, "torrent": 2, "track": 1, "tracker": 1, "tracking": 1,
    "werbung": 1, "wette": 1, "wetten": 1, "win": 1, "winner": 1,
}
SOFT_LIMIT, SOFT_DISTINCT = 2, 2
#: Most terms that are read from a table; they are sent to every task.
MAX_TERMS = 100_000
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def read_vocabulary(terms: DataFrame, limit: int = MAX_TERMS) -> tuple[tuple[str, ...], dict[str, int]]:
    """Strict and soft terms of a table (term, weight, strict), A-Z lower-cased. A
    null or empty term is left out, of several rows of a term the strictest and
    heaviest counts, and more than ``limit`` terms are an error."""
    lowered = terms.select(ascii_lower(F.col("term")).alias("term"), F.coalesce("weight", F.lit(1)).alias("weight"), F.coalesce("strict", F.lit(False)).alias("strict"))
    rows = lowered.where("term <> ''").groupBy("term").agg(F.max("weight").alias("weight"), F.max("strict").alias("strict")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} terms")
    return tuple(sorted(r["term"] for r in rows if r["strict"])), {r["term"]: r["weight"] for r in rows if not r["strict"]}


@lru_cache(maxsize=8)
def _automaton(strict: tuple, soft: tuple):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term, weight in (*soft, *((t, None) for t in strict)):
        automaton.add_word(term, (term, weight))
    automaton.make_automaton()
    return automaton


def vocabulary_hits(text: str, automaton) -> tuple[int, int, int]:
    """(strict terms, distinct soft terms, their summed weight) found in ``text``."""
    found = {}
    for end, (term, weight) in automaton.iter(text) if len(automaton) else ():
        start = end - len(term) + 1
        before = text[start - 1] if start else " "
        after = text[end + 1] if end + 1 < len(text) else " "
        if not _word_char(before) and not _word_char(after):
            found[term] = weight
    soft = [w for w in found.values() if w is not None]
    return len(found) - len(soft), len(soft), sum(soft)


def _word_char(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def rule_column(host: Column, path: Column, rules, pick: int) -> Column:
    """Text (``pick=0``) or verdict (``pick=1``) of the longest fitting rule;
    among equally long ones the first listed. Null when none fits."""
    out = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(reversed(list(rules)), key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.lit((rule_host + rule_path, verdict)[pick])).otherwise(out)
    return out


def url_filter(
    df: DataFrame,
    url_col: str = "url",
    id_col: str = "page_id",
    rules=RULES,
    strict=STRICT,
    soft: dict[str, int] | None = None,
    soft_limit: int = SOFT_LIMIT,
    soft_distinct: int = SOFT_DISTINCT,
) -> DataFrame:
    """``id_col``, host, path, rule, n_strict, n_soft, soft_weight, verdict (allow/block)."""
    strict, soft = tuple(sorted(strict)), tuple(sorted((SOFT if soft is None else soft).items()))

    @F.pandas_udf("n_strict int, n_soft int, soft_weight int")
    def hits(urls: pd.Series) -> pd.DataFrame:
        automaton = _automaton(strict, soft)
        return pd.DataFrame([vocabulary_hits(u, automaton) for u in urls], columns=["n_strict", "n_soft", "soft_weight"], dtype="int32")

    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = df.select(
        F.col(id_col),
        ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1).alias("path"),
        hits(ascii_lower(url)).alias("_hits"),
    )
    rejected = (F.col("_hits.n_strict") > 0) | ((F.col("_hits.n_soft") >= soft_distinct) & (F.col("_hits.soft_weight") >= soft_limit))
    host, path = F.col("host"), F.col("path")
    return parts.select(
        id_col,
        "host",
        "path",
        rule_column(host, path, rules, 0).alias("rule"),
        F.coalesce(rule_column(host, path, rules, 1), F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        "_hits.n_strict",
        "_hits.n_soft",
        "_hits.soft_weight",
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _hit(term: str) -> str:
    return f"CAST(regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS INT)"


ORACLE = f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u, coalesce(url, '') AS raw FROM pages
), b AS (
  SELECT page_id, u, regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1) AS host, regexp_extract(raw, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM a
), c AS (
  SELECT *, CAST({" + ".join(_hit(t) for t in STRICT)} AS INT) AS n_strict, CAST({" + ".join(_hit(t) for t in SOFT)} AS INT) AS n_soft, CAST({" + ".join(f"{w} * {_hit(t)}" for t, w in SOFT.items())} AS INT) AS soft_weight,
    CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM b
)
SELECT page_id, host, path, rule, n_strict, n_soft, soft_weight,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN n_strict > 0 OR n_soft >= {SOFT_DISTINCT} AND soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
