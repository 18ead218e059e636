"""URL filter: host and path rules, and a weighted vocabulary found by Aho-Corasick.

The longest rule that fits decides. For other urls one automaton finds all terms of the whole url, scheme, query and
fragment included, in one pass, A-Z lower-cased; a term counts only between characters that are no ASCII letters
or digits. One strict term rejects, and so do SOFT_HITS different soft terms.

Defined results: a null url, or one without ://, has an empty host and path and fits no rule; its terms
count all the same. Equal rules' order does not matter, as the longest wins. Very long urls are read whole. Extra
columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, start of the path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
# Own vocabulary, fixed values: words of urls in English, French, German and Spanish, lower-cased.
STRICT = (
    "bestiality", "blowjob", "camgirls", "camsex", "casino", "casinos", "cracked", "cumshot", "darkmarket", "escort", "escorts", "exploitkit", "fakeid", "gangbang", "hentai", "hookup",
    "jackpot", "keylogger", "malware", "milf", "nulled", "onlinecasino", "phishing", "porn", "porno", "pornos", "putas", "ransomware", "roulette", "sexcam", "sexe", "sexo", "spielautomaten",
    "spyware", "tragaperras", "viagra", "warez", "xxx", "xxxvideos",
)
SOFT = (
    "abnehmen", "adulte", "adulto", "adults", "adult", "apuestas", "arznei", "bargain", "bet", "bets", "betting", "billig", "bingo", "bitcoin", "bonus", "cashback", "cheap", "citas", "clickbait",
    "coupon", "crack", "credit", "credito", "cialis", "dating", "deal", "deals", "descarga", "descargar", "diet", "discount", "download", "downloads", "erotic", "erotik", "erotique", "essays",
    "forex", "free", "gagner", "gambling", "ganar", "geldspiel", "gewinn", "gewinnen", "giveaway", "gratis", "gratuit", "gratuito", "herunterladen", "hot", "hypothek", "insurance", "kasino", "kaufen",
    "keygen", "kostenlos", "kredit", "loan", "loans", "loteria", "loterie", "lottery", "lotto", "lucky", "massage", "medikamente", "mortgage", "naked", "nackt", "nude", "nudes", "oferta", "offre",
    "offshore", "paris-sportifs", "pharmacy", "pharmacie", "pills", "pirate", "poker", "pret", "premio", "prestamo", "prize", "promo", "rabatt", "regalo", "rencontre", "rencontres", "replica",
    "scam", "serial", "sex", "sexy", "slots", "spam", "steroids", "streaming", "sweepstakes", "telecharger", "torrent", "torrents", "tracker", "trading", "trick", "voyance", "webcam", "wetten", "win",
    "winner", "wins",
)
SOFT_HITS = 2


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(url: Column) -> Column:
    return F.translate(F.coalesce(url, F.lit("")), _AZ, _AZ.lower())


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end; A-Z lower-cased."""
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_col: Column, path_col: Column, rules=tuple(RULES)) -> tuple[Column, Column]:
    """(text of the longest rule that fits, its verdict), null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decided, own_host, own_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_col == own_host) | host_col.endswith("." + own_host)) & path_col.startswith(own_path)
        name, verdict = F.when(fits, own_host + own_path).otherwise(name), F.when(fits, decided).otherwise(verdict)
    return name, verdict


def _automaton(strict, soft):
    import ahocorasick

    out = ahocorasick.Automaton()
    for weight, terms in ((2, strict), (1, soft)):
        for term in terms:
            out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def hits(automaton, text: str) -> tuple[int, int]:
    """Numbers of different strict and soft terms between boundaries."""
    found = set()
    for end, (term, weight) in automaton.iter(text):
        start = end - len(term) + 1
        if not (start and text[start - 1].isascii() and text[start - 1].isalnum()) and not (end + 1 < len(text) and text[end + 1].isascii() and text[end + 1].isalnum()):
            found.add((weight, term))
    return sum(w == 2 for w, _ in found), sum(w == 1 for w, _ in found)


def _judge(strict, soft, soft_hits: int):
    def run(batches):
        automaton = _automaton(strict, soft)
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            verdicts, n_strict, n_soft = [], [], []
            for url, decided in zip(columns["url"].to_pylist(), columns["decided"].to_pylist(), strict=True):
                s, w = hits(automaton, url)
                verdicts.append(decided or ("block" if s or w >= soft_hits else "allow"))
                n_strict.append(s)
                n_soft.append(w)
            yield pa.RecordBatch.from_arrays([columns["page_id"], columns["host"], columns["path"], columns["rule"], pa.array(verdicts, pa.string()), pa.array(n_strict, pa.int32()), pa.array(n_soft, pa.int32())], ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return run


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=tuple(RULES), strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, n_strict, n_soft (different terms)."""
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), lowered(url).alias("url"))
    name, decided = rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": name, "decided": decided})
    kind = dict(pages.dtypes)[id_col]
    return parts.mapInArrow(_judge(strict, soft, soft_hits), f"page_id {kind}, host string, path string, rule string, verdict string, n_strict int, n_soft int")
