"""Scalar functions: Columns in, Column out. Nothing here reads the clock; times are arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(count: Column, total: Column, digits: int = 2, empty: float | None = None) -> Column:
    """count as a share of total in percent, rounded half up by whole numbers, so that every engine agrees; `empty` where total is 0."""
    scale = 10**digits
    count, total = count.cast("long"), total.cast("long")
    share = F.when(total != 0, _div(count * (200 * scale) + total, total * 2).cast("double") / scale)
    return F.coalesce(share, F.lit(empty).cast("double")) if empty is not None else share


def _div(a: Column, b: Column) -> Column:
    """Whole-number division; null where b is 0."""
    return F.floor(F.try_divide(a.cast("decimal(38,0)"), b.cast("decimal(38,0)")))


def half_up(x: Column, digits: int) -> Column:
    """x rounded half up at the digits, by adding a half and cutting: floor(x * 10**digits + 0.5) / 10**digits."""
    return F.floor(x * 10**digits + F.lit(0.5)) / 10**digits


def trend(current: Column, previous: Column) -> Column:
    """new without a previous value; up or down beyond a point; else stable."""
    gap = current.cast("double") - previous.cast("double")
    return F.when(previous.isNull(), "new").when(gap > 1.0, "up").when(gap < -1.0, "down").otherwise("stable")


def confidence(players: Column, stale: Column) -> Column:
    return F.when((players >= 100) & (stale == 0), "high").when((players >= 30) & (stale <= 5), "medium").otherwise("low")


def winrate_pct(wins: Column, losses: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(wins * 100.0, wins + losses), F.lit(empty))


def player_score(rating: Column, wins: Column, losses: Column) -> Column:
    """Rating, plus 6 a point of win rate over 60 (120 at most), less 8 a point under 60, more so after 200 games (300 at most)."""
    games, rate = wins + losses, F.try_divide(wins * 100.0, wins + losses)
    bonus = F.least(F.lit(120.0), F.greatest(F.lit(0.0), (rate - 60) * 6))
    weight = F.least(F.lit(1.5), F.greatest(F.lit(0.0), (games - 200) / 200.0))
    return rating + bonus - F.least(F.lit(300.0), F.greatest(F.lit(0.0), (60 - rate) * 8 * weight))


#: How item texts name the four secondary stats.
STAT_WORDS = {"haste": "Haste", "crit": "Crit", "mastery": "Mastery", "versatility": "Versatil"}


def parse_stat(text: Column, stat: str) -> Column:
    """First `+N stat` of a text, any case, as a whole number; null without one."""
    return F.regexp_extract(text, rf"(?i)\+\s*(\d+)\s+{STAT_WORDS[stat]}", 1).try_cast("int")


def clean_enchant_name(text: Column) -> Column:
    """Without |A:...|a markup and the prefix `Enchanted: `, trimmed."""
    bare = F.trim(F.regexp_replace(text, r"\|A:[^|]*\|a", ""))
    return F.trim(F.regexp_replace(bare, r"^Enchanted:\s*", ""))


#: The tags that end a line, `<br>` and these at their end.
LINE_TAGS = ("div", "p", "td", "tr", "li")


def strip_html(text: Column) -> Column:
    """Tags that end a line become line feeds, other tags go, runs of three and more line feeds become two; null if nothing is left."""
    t = F.regexp_replace(text, rf"(?i)<br\s*/?>|</(?:{'|'.join(LINE_TAGS)})>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", ""), r"\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(t, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), F.lit(""))


def host_rewrite(url: Column, host: str, base: str) -> Column:
    """base and the url's path where the url is one of the host; other urls and null stay."""
    return F.when(F.try_parse_url(url, F.lit("HOST")) == host, F.concat(F.lit(base), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))).otherwise(url)


def fingerprint(items: Column) -> Column:
    """slot:item:level:enchant:crafts of an array of such structs, sorted and joined; null parts are empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    each = F.transform(items, lambda i: F.concat_ws(":", part(i["slot"]), part(i["item"]), part(i["level"]), part(i["enchant"]), part(i["crafts"])))
    return F.array_join(F.array_sort(each), ",")


def normalise_id(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int"))


def bracket_class(bracket: Column) -> Column:
    """class slug of a per-spec solo bracket, with underscores; null for others."""
    return F.nullif(F.translate(F.regexp_extract(bracket, r"^(?:shuffle|blitz)-(.+)-([^-]+)$", 1), "-", "_"), F.lit(""))


def bracket_spec(bracket: Column) -> Column:
    return F.nullif(F.regexp_extract(bracket, r"^(?:shuffle|blitz)-(.+)-([^-]+)$", 2), F.lit(""))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")


def tree_ids(href: Column) -> Column:
    """(tree, spec) of a path .../talent-tree/T/playable-specialization/S."""
    at = lambda k: F.regexp_extract(href, r"talent-tree/(\d+)/playable-specialization/(\d+)", k).try_cast("int")
    return F.struct(at(1).alias("tree_id"), at(2).alias("spec_id"))


def faction_code(kind: Column) -> Column:
    return F.when(kind == "ALLIANCE", 0).when(kind == "HORDE", 1)


def bracket_top_n(bracket: Column) -> Column:
    """Entries of a ladder that are kept."""
    return F.when(bracket.isin("2v2", "3v3"), 2500).otherwise(500)


def progress_pct(done: Column, expected: Column) -> Column:
    return F.coalesce(F.floor(F.try_divide(done * 100, expected)).cast("int"), F.lit(0))


def eta_seconds(done: Column, expected: Column, elapsed: Column) -> Column:
    """Seconds left at the pace so far; null before the first is done and in the last fiftieth."""
    left = F.try_divide(expected - done, expected)
    return F.when((done > 0) & (left >= 0.02), F.round(elapsed / done * (expected - done)).cast("long"))


def format_elapsed(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60)
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%dh %dm", h, m % 60))


def display_name(name: Column, realm: Column) -> Column:
    return F.concat(F.initcap(name), F.lit("-"), F.initcap(F.translate(realm, "-", " ")))


def realm_title(realm: Column) -> Column:
    return F.nullif(F.initcap(F.translate(realm, "-", " ")), F.lit(""))


def class_title(slug_: Column) -> Column:
    return F.nullif(F.translate(slug_, "_", "-"), F.lit(""))


def best_description(ranks: Column) -> Column:
    """description of the highest rank of an array of (rank, description); null descriptions don't count."""
    said = F.filter(ranks, lambda r: r["description"].isNotNull())
    return F.array_max(F.transform(said, lambda r: F.struct(r["rank"], r["description"])))["description"]


def meta_synced(icon: Column, synced_at: Column, as_of: Column) -> Column:
    return icon.isNotNull() & F.coalesce(synced_at >= as_of - F.expr("INTERVAL 7 DAYS"), F.lit(False))


def http_date(text: Column) -> Column:
    """`Wed, 01 Jan 2026 12:00:00 GMT` as a timestamp; null for blank or other text. The weekday is not read."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.try_to_timestamp(F.nullif(bare, F.lit("")), F.lit("dd MMM yyyy HH:mm:ss z"))


def escape_like(text: str) -> str:
    """text with the wildcards of LIKE made plain."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
