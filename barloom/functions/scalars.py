"""Code, board, rating, date and text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lock-up types by exact name, then by fragment (first match wins).
UNLOCK_EXACT = {
    "首发原股东限售股份": "ipo",
    "首发战略配售股份": "ipo",
    "首发机构配售股份": "ipo",
    "定向增发机构配售股份": "spo",
    "股权激励限售股份": "incentive",
    "追加承诺限售股份上市流通": "other",
    "股权分置限售股份": "other",
}
UNLOCK_PARTS = [("首发", "ipo"), ("定向增发", "spo"), ("定增", "spo"), ("激励", "incentive")]

# Analyst rating text to score.
RATING_SCORES = {
    "买入": 2, "强烈推荐": 2, "强推": 2,
    "增持": 1, "推荐": 1, "谨慎推荐": 1, "审慎推荐": 1, "优于大市": 1,
    "持有": 0, "中性": 0, "同步大市": 0, "区间操作": 0,
    "减持": -1, "弱于大市": -1, "回避": -1,
    "卖出": -2,
}

# Board labels by code prefix (bare codes, prefixed codes).
BOARDS_BARE = [
    ("^00[0-3]", "深主板"), ("^30[01]", "创业板"), ("^60", "沪主板"), ("^688", "科创板"), ("^[84]", "北交所"),
]
BOARDS_BY_HEAD = [("^60", "沪主板"), ("^00", "深主板"), ("^30", "创业板")]
BOARDS_PREFIXED = [
    ("^sh60", "沪主板"), ("^sh68", "科创板"), ("^sz00", "深主板"), ("^sz30", "创业板"), ("^bj", "北交所"),
]


def pad_code(c: Column) -> Column:
    return F.lpad(c.cast("string"), 6, "0")


def strip_prefix(c: Column) -> Column:
    """Drop a leading exchange tag in either case."""
    return F.regexp_replace(c, "^(?i)(sh|sz|bj)", "")


def _tag(c: Column, sh: str, bj: str | None) -> Column:
    tag = F.when(c.rlike(sh), "SH")
    return (tag.when(c.rlike(bj), "BJ") if bj else tag).otherwise("SZ")


def add_prefix(c: Column, *, sh: str = "^6", bj: str | None = None, lower: bool = False) -> Column:
    """Exchange tag before the code; which first digits mean Shanghai/Beijing varies by feed."""
    tag = _tag(c, sh, bj)
    return F.concat(F.lower(tag) if lower else tag, c)


def add_suffix(c: Column, *, sh: str = "^[69]", bj: str | None = "^[84]") -> Column:
    """600519 -> 600519.SH."""
    return F.concat(c, F.lit("."), _tag(c, sh, bj))


def _ladder(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    out = F.when(c.rlike(rules[0][0]), rules[0][1])
    for pattern, label in rules[1:]:
        out = out.when(c.rlike(pattern), label)
    return out.otherwise(default)


def board_of(c: Column) -> Column:
    """Board of a bare six-digit code."""
    return F.when(c.isNull() | (F.length(c) < 3), "未知").otherwise(_ladder(c, BOARDS_BARE, "其他"))


def board_by_head(c: Column) -> Column:
    """Board by the first two digits alone, as coverage is counted."""
    return _ladder(c, BOARDS_BY_HEAD, "其他")


def board_of_prefixed(c: Column) -> Column:
    return _ladder(c, BOARDS_PREFIXED, "其他")


def rating_score(c: Column, table: dict[str, int] = RATING_SCORES) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def rating_change(now: Column, before: Column) -> dict[str, Column]:
    """Delta and upgrade / downgrade / reaffirm flags of one report."""
    d = now - before
    flag = lambda c: F.when(c, 1).otherwise(0)
    return {"rating_delta": d, "is_upgrade": flag(d > 0), "is_downgrade": flag(d < 0), "is_reaffirm": flag(d == 0)}


def unlock_type(c: Column) -> Column:
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNLOCK_EXACT.items() for x in kv]), c)
    parts = F.when(c.isNull(), "other")
    for part, kind in UNLOCK_PARTS:
        parts = parts.when(c.contains(part), kind)
    return F.coalesce(exact, parts.otherwise("other"))


def month_key(c: Column) -> Column:
    return F.trunc(c, "month")


def business_days(start: Column, end: Column) -> Column:
    """Array of weekdays between two dates."""
    return F.filter(F.sequence(start, end), lambda d: F.weekday(d) < 5)


def bar_start(ts: Column, minutes: int = 5) -> Column:
    """Start of a bar stamped with its end."""
    return ts - F.expr(f"INTERVAL {minutes} MINUTES")


def first_of_list(c: Column, sep: str = "|") -> Column:
    return F.split_part(c, F.lit(sep), F.lit(1))


def valuation_tag(pe: Column) -> Column:
    """Ladder at PE 35 / 25 / 15 / 0; unknown or negative earnings give "?"."""
    return F.when(pe > 35, "高估").when(pe > 25, "略高").when(pe > 15, "合理").when(pe > 0, "低估").otherwise("?")


def limit_threshold(c: Column, *, normal: float = 0.095, wide: float = 0.195, wide_prefix: str = "^(SH688|SZ300)") -> Column:
    """Price-limit threshold of a prefixed symbol."""
    return F.when(c.rlike(wide_prefix), wide).otherwise(normal)


def is_special_treatment(name: Column) -> Column:
    """ST / delisting / PT names; an empty name counts as special."""
    n = F.upper(F.replace(name, F.lit(" "), F.lit("")))
    return F.coalesce((n == "") | n.rlike("ST|退|PT"), F.lit(True))
