"""Texts to all their occurrences: lists of days, holidays, lunar dates, ranges, bounds, shifts, recurrences.

A text splits into a main part, what follows "đến" (an end of a range, or the last day of a rule) and what
follows "trừ" (weekdays left out). The fields of the parts are patterns over the lexicon; holidays and lunar
dates meet the small table of named days by one equality (Spark broadcasts it where it is small); dates, clocks and rules are array
expressions on the same row. There is no shuffle, and a text's occurrences are exploded only at the end.

Per occurrence: clause and seq in it (from 1), start, end (exclusive; null for a moment or one whole day), open ("start" or
"end" of a one-sided bound), all_day, rrule, truncated (there were more than `limit`). A text without a
sound expression gives one row with nulls and a diagnostic; so do null and empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoframe.functions import civil
from kairoframe.functions.lexicon import (
    BRANCH_VARIANTS, BRANCHES, DAY_GROUPS, DAY_PARTS, EDGES, HOLIDAY_OF, MODIFIERS, MONTHS, NAMED_ENDS, NAMED_STARTS, NAMED_TIMES, NOW_WORDS, RELATIVE_DAYS,
    STEMS, UNITS, WEEKDAYS, alternatives, lookup, sexagenary,
)
from kairoframe.functions.numerals import spelled_number
from kairoframe.functions.text import key
from kairoframe.operators import dates, recurrence

from .parse import CLOCK, EDGE, found

#: The zone that rules name where rows have none of their own.
HOME = "Asia/Ho_Chi_Minh"
MODS = alternatives(MODIFIERS)
UNIT = r"giây|phút|giờ|tiếng|ngày|tuần|tháng|năm|h|ph|p"
AMOUNT = rf"([\p{{L}}\d]+(?: [\p{{L}}\d]+)*?) ?({UNIT})"
SHIFT = rf"^{AMOUNT}(?: {AMOUNT})? (nữa|sau|trước|kể từ bây giờ)(?: (.+))?$"
NUMERIC = r"(?<![\d/.-])(\d{1,2})[/.-](\d{1,2})(?:[/.-](\d{4}))?(?![\d/])"
YEAR_FIRST = r"(?<![\d/.-])(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})(?![\d/])"
PAIR = rf"({'|'.join(STEMS)}) ({'|'.join([*BRANCHES, *BRANCH_VARIANTS])})(?![\p{{L}}])"


def take(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def number(text: Column, pattern: str, group: int = 1) -> Column:
    return take(text, pattern, group).try_cast("int")


def split(df: DataFrame, text: Column) -> DataFrame:
    """Append the parts of a text: what it says first, the end, the exceptions; its count, shift and rule words."""
    df = df.withColumn("_t", F.trim(F.regexp_replace(text, r"[.!?]+$", "")))
    df = df.withColumn("_except", take(F.col("_t"), r"(?:^| )(?:trừ|ngoại trừ) (.+)$")).withColumn("_said", F.regexp_replace("_t", r",? ?(?:trừ|ngoại trừ) .+$", ""))
    df = df.withColumn("_count", number(F.col("_said"), r"(\d+) lần$")).withColumn("_said", F.regexp_replace("_said", r",? \d+ lần$", ""))
    df = df.withColumn("_rule", F.coalesce(F.col("_t").rlike(EDGE % "mỗi|mọi|hàng|hằng"), F.lit(False)))
    cut = r"^(.*?) ?(?<![\p{L}])(?:đến|(?<=từ .{1,60} )tới)(?: hết)? (.+)$"
    df = df.withColumn("_l", take(F.col("_said"), cut, 2))
    first = F.when(F.col("_l").isNull(), F.col("_said")).otherwise(F.regexp_extract("_said", cut, 1))
    df = df.withColumn("_f", F.regexp_replace(F.regexp_replace(first, r"(?:^|(?<= ))(?<!kể )từ (?!đó)", ""), r"^cách đây (.+)$", r"$1 trước"))
    df = df.withColumns({"_n1": spelled_number(take(F.col("_f"), SHIFT, 1), True), "_n2": spelled_number(take(F.col("_f"), SHIFT, 3), True), "_dir": take(F.col("_f"), SHIFT, 5)})
    df = df.withColumns({"_u1": lookup(UNITS, take(F.col("_f"), SHIFT, 2)), "_u2": lookup(UNITS, take(F.col("_f"), SHIFT, 4)), "_rest": take(F.col("_f"), SHIFT, 6)})
    df = df.withColumn("_shift", F.col("_n1").isNotNull() & ~F.col("_rule") & (F.col("_u2").isNull() | F.col("_n2").isNotNull()))
    df = df.withColumns({"_dn": spelled_number(take(F.col("_f"), rf"^trong (?:vòng )?{AMOUNT}$", 1), True), "_du": lookup(UNITS, take(F.col("_f"), rf"^trong (?:vòng )?{AMOUNT}$", 2))})
    df = df.withColumn("_bound", F.when(~F.col("_shift"), take(F.col("_f"), r"^(sau|trước) (?=.*\d)", 1)))
    return df.withColumn("_f", F.when(F.col("_shift"), F.coalesce("_rest", F.lit(""))).otherwise(F.col("_f")))


def clauses(said: Column) -> Column:
    """A text's key cut before each weekday after "và", where both sides have clocks of their own."""
    clock = r"\d{1,2} ?(?:giờ|h(?![\p{L}])|:)"
    both = said.rlike(rf"{clock}.* và (?:{alternatives(WEEKDAYS)})(?![\p{{L}}]).*{clock}")
    return F.when(both, F.split(said, rf" và (?=(?:{alternatives(WEEKDAYS)})(?![\p{{L}}]))")).otherwise(F.array(said))


def fields(df: DataFrame, p: str, order: str = "DMY") -> DataFrame:
    """Append what part `p` names, each under the part's prefix; numeric dates without a number over 12 read in this order."""
    x = F.col(p)
    df = df.withColumns({f"{p}_a": number(x, NUMERIC, 1), f"{p}_b": number(x, NUMERIC, 2), f"{p}_pair": take(x, PAIR, 0)})
    month_first = F.col(f"{p}_a") <= 12 if order == "MDY" else F.lit(False)
    swap = ((F.col(f"{p}_b") > 12) & (F.col(f"{p}_a") <= 12)) | (month_first & (F.col(f"{p}_b") <= 12))
    a, b = F.when(swap, F.col(f"{p}_b")).otherwise(F.col(f"{p}_a")), F.when(swap, F.col(f"{p}_a")).otherwise(F.col(f"{p}_b"))
    cycle = sexagenary(take(x, PAIR, 1), take(x, PAIR, 2))
    hour, minute = number(x, CLOCK, 1), F.regexp_extract(x, CLOCK, 2)
    before = F.regexp_extract(minute, r"kém (\d+)", 1).try_cast("int")
    named = F.coalesce(lookup(NAMED_STARTS, found(x, NAMED_STARTS)), lookup(NAMED_TIMES, found(x, NAMED_TIMES)))
    hour = F.when(before.isNotNull(), hour - 1).otherwise(hour)
    part = lookup(DAY_PARTS, found(x, DAY_PARTS))
    return df.withColumns(
        {
            f"{p}_hol": lookup(HOLIDAY_OF, found(x, HOLIDAY_OF)),
            f"{p}_tet_day": number(x, r"(?:mùng|mồng) (\d{1,2}) tết"),
            f"{p}_dom": F.coalesce(number(x, YEAR_FIRST, 3), a, number(x, r"(?<![\p{L}])(?:ngày|mùng|mồng) (\d{1,2})(?![\d/])"), F.when(x.rlike(EDGE % "rằm"), 15)),
            f"{p}_month": F.coalesce(number(x, YEAR_FIRST, 2), b, lookup(MONTHS, take(x, rf"(?<![\p{{L}}])tháng ({alternatives(MONTHS)})(?![\p{{L}}\d])"))),
            f"{p}_year": F.coalesce(number(x, YEAR_FIRST, 1), number(x, NUMERIC, 3), number(x, r"(?<![\p{L}])năm (\d{4})(?!\d)"), number(x, r"(?<![\d/])(\d{4})$")),
            f"{p}_cycle": F.when(~x.rlike(r"(?<![\p{L}])giờ " + PAIR), cycle),
            f"{p}_lunar": x.rlike(EDGE % "âm lịch|lịch âm|lịch ta|âl|âm|mùng|mồng|rằm|nhuận|giêng|chạp"),
            f"{p}_leap": x.rlike(EDGE % "nhuận"),
            f"{p}_dows": F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(EDGE % alternatives(WEEKDAYS)), F.lit(0)), lambda w: lookup(WEEKDAYS, w))),
            f"{p}_dow_mod": lookup(MODIFIERS, take(x, rf"(?:{alternatives(WEEKDAYS)})(?: tuần)? ({MODS})(?![\p{{L}}])")),
            f"{p}_unit": lookup(UNITS, take(x, rf"(?<![\p{{L}}])(tuần|tháng|năm) (?:{MODS})(?![\p{{L}}])")),
            f"{p}_unit_mod": lookup(MODIFIERS, take(x, rf"(?<![\p{{L}}])(?:tuần|tháng|năm) ({MODS})(?![\p{{L}}])")),
            f"{p}_more": F.when(x.rlike(rf"(?:{MODS}) nữa(?![\p{{L}}])"), 1).otherwise(0),
            f"{p}_week_no": number(x, r"(?<![\p{L}])tuần (?:thứ )?(\d)(?: của)? tháng"),
            f"{p}_quarter": number(x, r"(?<![\p{L}])quý ([1-4])(?!\d)"),
            f"{p}_edge": lookup(EDGES, take(x, r"(?<![\p{L}])(đầu|giữa|cuối) (?:tháng|năm)(?![\p{L}])")),
            f"{p}_edge_of": lookup(UNITS, take(x, r"(?<![\p{L}])(?:đầu|giữa|cuối) (tháng|năm)(?![\p{L}])")),
            f"{p}_group": lookup(DAY_GROUPS, found(x, DAY_GROUPS)),
            f"{p}_group_mod": lookup(MODIFIERS, take(x, rf"(?:{alternatives(DAY_GROUPS)}) ({MODS})(?![\p{{L}}])")),
            f"{p}_rel": lookup(RELATIVE_DAYS, found(x, RELATIVE_DAYS)),
            f"{p}_nth": F.when(x.rlike(r"(?:đầu tiên|thứ nhất)(?![\p{L}])"), 1).when(x.rlike(r"cuối cùng(?![\p{L}])"), -1),
            f"{p}_part": part,
            f"{p}_hour": F.coalesce(named, hour),
            f"{p}_named": named.isNotNull(),
            f"{p}_until_hour": lookup(NAMED_ENDS, found(x, NAMED_ENDS)),
            f"{p}_minute": F.when(named.isNotNull() | (minute == ""), 0).when(minute == "rưỡi", 30).when(before.isNotNull(), 60 - before).otherwise(minute.try_cast("int")),
        }
    )


def seconds(hour: Column, minute: Column, part: Column, named: Column) -> Column:
    """Seconds of the day of a clock reading; null where it is none. Twenty-four is zero."""
    folded = F.when(named | part.isNull(), hour).otherwise(civil.fold_hour(hour, part))
    return F.when((hour <= 24) & (minute < 60), F.pmod(folded, F.lit(24)) * 3600 + minute * 60).cast("int")


def periods(p: str, today: Column, base: Column) -> Column:
    """The whole days and periods (s, e) that part `p` names, ascending; null where it names none, empty where they aren't dates."""
    c = lambda n: F.col(f"{p}_{n}")
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    one = lambda s, e: F.filter(F.array(span(s, e)), lambda x: x["s"].isNotNull())
    single = lambda d: one(d, F.date_add(d, 1))
    unit_start, unit_end = F.lit(None).cast("date"), F.lit(None).cast("date")
    steps = F.when(c("unit_mod") == "next", 1 + c("more")).when(c("unit_mod") == "last", -1 - c("more")).otherwise(0)
    for unit in ("week", "month", "year"):
        first = F.date_trunc(unit, today.cast("timestamp_ntz"))
        unit_start = F.when(c("unit") == unit, F.timestamp_add(unit.upper(), steps, first).cast("date")).otherwise(unit_start)
        unit_end = F.when(c("unit") == unit, F.timestamp_add(unit.upper(), steps + 1, first).cast("date")).otherwise(unit_end)
    month_start, month_end = dates.month_period(today, c("year"), c("month"))
    whole_s = F.when(c("month").isNotNull(), month_start).when(c("unit").isNotNull(), unit_start).when(c("edge_of") == "year", F.trunc(today, "year")).otherwise(F.trunc(today, "month"))
    whole_e = F.when(c("month").isNotNull(), month_end).when(c("unit").isNotNull(), unit_end).when(c("edge_of") == "year", F.add_months(F.trunc(today, "year"), 12)).otherwise(F.add_months(F.trunc(today, "month"), 1))
    middle = F.when(c("edge_of") == "year", F.add_months(whole_s, 6)).otherwise(F.date_add(whole_s, 14))
    edge = F.when(c("edge") == "start", whole_s).when(c("edge") == "end", F.date_sub(whole_e, 1)).otherwise(middle)
    week = F.when(c("dow_mod") == "next", 7 * c("more")).when(c("dow_mod") == "last", -7 * c("more")).otherwise(0)
    weekdays = F.transform(c("dows"), lambda w: F.date_add(civil.weekday_near(base, w, c("dow_mod")), week))
    listed = lambda days: F.array_sort(F.transform(days, lambda d: span(d, F.date_add(d, 1))))
    calendar = dates.calendar_day(today, c("year"), c("month"), c("dom"))
    out = F.when(c("dom").isNotNull(), single(calendar)).when(F.size(c("dows")) > 0, listed(weekdays)).when(c("group").isNotNull(), listed(dates.group_days(today, c("group"), c("group_mod"))))
    week_s, week_e = civil.week_of_month(month_start, c("week_no"))
    quarter_s, quarter_e = civil.quarter(F.coalesce(F.make_date(c("year"), F.lit(1), F.lit(1)), today), c("quarter"))
    past = F.when(c("year").isNull() & (quarter_e <= today), 12).otherwise(0)
    out = out.when(c("week_no").isNotNull() & c("month").isNotNull(), one(week_s, week_e)).when(c("quarter").isNotNull(), one(F.add_months(quarter_s, past), F.add_months(quarter_e, past)))
    out = out.when(c("edge").isNotNull(), single(edge)).when(c("month").isNotNull(), one(month_start, month_end)).when(c("unit").isNotNull(), one(unit_start, unit_end))
    return out.when(c("rel").isNotNull(), single(F.date_add(today, c("rel"))))


def shifted(at: Column, amount: Column, unit: Column, zone: Column | None) -> Column:
    """A wall clock moved by an amount: clock units pass as elapsed time in the zone, if there is one; half days are hours."""
    whole = amount.cast("int")
    out = F.lit(None).cast("timestamp_ntz")
    for name in ("day", "week", "month", "year"):
        out = F.when((unit == name) & (amount == whole), F.timestamp_add(name.upper(), whole, at)).otherwise(out)
    out = F.when((unit == "day") & (amount != whole), F.timestamp_add("HOUR", (amount * 24).cast("int"), at)).otherwise(out)
    for name, length in (("second", 1), ("minute", 60), ("hour", 3600)):
        step = (amount * length).cast("int")
        moved = F.timestamp_add("SECOND", step, at)
        if zone is not None:
            moved = F.from_utc_timestamp(F.timestamp_add("SECOND", step, F.to_utc_timestamp(at.cast("timestamp"), zone)), zone).cast("timestamp_ntz")
        out = F.when(unit == name, moved).otherwise(out)
    return out


def rule_days(today: Column) -> Column:
    """The candidate days of a rule to its last day, or twelve months on."""
    d = lambda x: F.when(F.col("_freq") == "DAILY", F.lit(True))
    monthly = lambda x: F.when(F.col("_f_dom").isNotNull(), F.dayofmonth(x) == F.col("_f_dom")).when(
        F.col("_f_nth").isNotNull(), x == civil.ordinal_weekday(F.trunc(x, "month"), F.get("_f_dows", F.lit(0)), F.col("_f_nth"))
    ).otherwise(F.dayofmonth(x) == F.dayofmonth(today))
    yearly = lambda x: (F.month(x) == F.coalesce("_f_month", F.month(today))) & (F.dayofmonth(x) == F.coalesce("_f_dom", F.dayofmonth(today)))
    match = lambda x: d(x).when(F.col("_freq") == "WEEKLY", True).when(F.col("_freq") == "MONTHLY", monthly(x)).otherwise(yearly(x))
    on = lambda x: F.col("_by_day").isNull() | F.col("_freq").isin("MONTHLY", "YEARLY") | F.array_contains("_by_day", F.weekday(x))
    return F.filter(recurrence.days(today, F.coalesce("_until", F.add_months(today, 12))), lambda x: match(x) & on(x))


def spaced(days: Column) -> Column:
    """Every interval-th day, week, month or year from the first."""
    first, n = F.get(days, F.lit(0)), F.col("_interval")
    gap = lambda x: F.when(F.col("_freq") == "DAILY", F.datediff(x, first)).when(F.col("_freq") == "WEEKLY", F.floor(F.datediff(civil.monday(x), civil.monday(first)) / 7)).when(
        F.col("_freq") == "MONTHLY", recurrence.months_between(first, x)
    ).otherwise(F.year(x) - F.year(first))
    return F.when(n > 1, F.filter(days, lambda x: gap(x) % n == 0)).otherwise(days)


def occurrences_df(df: DataFrame, reference: str, named: DataFrame, text_col: str = "text", zone: str | None = None, limit: int = 30, order: str = "DMY") -> DataFrame:
    """The rows of df, one for each occurrence; `named` is `dates.named_days`, `zone` a column of zone names.

    `order` (DMY or MDY) is how numeric dates read where neither number is over 12; a year first is followed by the month.
    """
    if order not in ("DMY", "MDY"):
        raise ValueError("order must be DMY or MDY")
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    ref, today = F.col("_ref"), F.col("_today")
    kept = [F.col(f"`{c}`") for c in df.columns]
    rows = df.withColumn("_whole", key(F.col(text_col))).select("*", F.posexplode(clauses(F.col("_whole"))).alias("_clause", "_text"))
    rows = split(rows.withColumn("_ref", F.col(reference).cast("timestamp_ntz")).withColumn("_today", F.col(reference).cast("date")), F.col("_text"))
    rows = fields(fields(rows, "_f", order), "_l", order)
    ranged = F.col("_l").isNotNull() & ~F.col("_rule")
    rows = rows.withColumn("_f_month", F.when(ranged & F.col("_f_dom").isNotNull(), F.coalesce("_f_month", "_l_month")).otherwise(F.col("_f_month")))
    lunar = F.col("_f_lunar")
    leap = F.when(F.col("_f_leap"), "-leap").otherwise("")
    day_key = F.when(F.col("_f_hol").isNotNull(), F.col("_f_hol")).when(lunar & F.col("_f_month").isNotNull(), F.concat(F.lit("L:"), F.col("_f_month"), F.lit("-"), F.coalesce("_f_dom", F.lit(1)), leap))
    day_key = day_key.when(lunar & F.col("_f_dom").isNotNull(), F.concat(F.lit("L:*-"), F.col("_f_dom"))).when(F.col("_f_cycle").isNotNull(), "tet")
    year = F.coalesce("_f_year", dates.cycle_year(F.col("_f_cycle"), F.year(today)))
    rows = rows.withColumn("day_key", day_key).withColumn("_year", year).join(named, "day_key", "left")
    found_day = F.date_add(dates.next_named(F.col("days"), today, F.col("_year")), F.coalesce(F.col("_f_tet_day") - 1, F.lit(0)))
    next_year = dates.next_named(F.col("days"), today, F.col("_year") + 1)
    bare_year = F.col("_f_cycle").isNotNull() & F.col("_f_hol").isNull() & ~lunar
    span = F.struct(found_day.alias("s"), F.when(bare_year, next_year).otherwise(F.date_add(found_day, 1)).alias("e"))
    rows = rows.withColumn("_p", F.when(F.col("day_key").isNotNull(), F.filter(F.array(span), lambda x: x["s"].isNotNull())).otherwise(periods("_f", today, today)))
    rows = rows.withColumn("_lp", periods("_l", today, F.coalesce(F.get("_p", F.lit(0))["s"], today)))
    rows = rows.withColumn("_at", seconds(F.col("_f_hour"), F.col("_f_minute"), F.col("_f_part"), F.col("_f_named")))
    rows = rows.withColumn("_to", F.coalesce(seconds(F.col("_l_hour"), F.col("_l_minute"), F.coalesce("_l_part", "_f_part"), F.col("_l_named")), F.col("_f_until_hour") * 3600))
    rows = _one_off(rows, ref, today, zone)
    rows = _rules(rows, ref, today, zone)
    bad_clock = (F.col("_f_hour").isNotNull() & F.col("_at").isNull()) | (F.col("_l_hour").isNotNull() & F.col("_to").isNull())
    bad_date = F.coalesce(F.size("_p") == 0, F.lit(False)) | F.coalesce(F.size("_lp") == 0, F.lit(False))
    error = F.when(bad_clock, "invalid-time").when(bad_date, "invalid-date").when(F.coalesce(F.size("_out"), F.lit(0)) == 0, "no-expression")
    rows = rows.withColumn("diagnostic", error).withColumn("_out", F.when(error.isNull(), F.col("_out")))
    rows = rows.withColumn("truncated", F.coalesce(F.size("_out") > limit, F.lit(False)) & error.isNull())
    shown = rows.select(*kept, "_clause", F.posexplode_outer(F.slice("_out", 1, limit)).alias("seq", "x"), F.when(error.isNull(), F.col("_rrule")).alias("rrule"), "truncated", "diagnostic")
    return shown.select(*kept, (F.col("_clause") + 1).alias("clause"), (F.col("seq") + 1).alias("seq"), "x.start", "x.end", "x.open", "x.all_day", "rrule", "truncated", "diagnostic")


def _occurrence(start, end, open_, all_day) -> Column:
    return F.struct(start.cast("timestamp_ntz").alias("start"), end.cast("timestamp_ntz").alias("end"), open_.cast("string").alias("open"), all_day.alias("all_day"))


def _hours(part: Column, edge: int) -> Column:
    out = F.lit(None).cast("int")
    for name, hours in civil.PART_HOURS.items():
        out = F.when(part == name, hours[edge] + (24 if edge and hours[1] <= hours[0] else 0)).otherwise(out)
    return out * 3600


def _one_off(rows: DataFrame, ref: Column, today: Column, zone: str | None) -> DataFrame:
    """Append `_events`: the occurrences of what doesn't recur."""
    none, nothing = F.lit(None), F.lit(None).cast("string")
    clock, dated = F.col("_at").isNotNull(), F.col("_p").isNotNull()
    ends = F.get("_lp", F.lit(0))
    starts_at, ends_at = _hours(F.col("_f_part"), 0), _hours(F.col("_f_part"), 1)
    plus = lambda d, s: F.timestamp_add("SECOND", s, d.cast("timestamp_ntz"))
    loose = F.col("_f_dow_mod").isNull() & (F.size("_f_dows") > 0) & F.col("_f_dom").isNull() & F.col("day_key").isNull()
    checked = lambda d: F.when(F.col("_bound") == "trước", plus(d, F.col("_at"))).otherwise(F.coalesce(F.when(F.col("_to") > F.col("_at"), plus(d, F.col("_to"))), plus(d, F.col("_at"))))
    rolled = lambda d: F.when(checked(d) < ref, F.when(~dated, F.date_add(d, 1)).when(loose, F.date_add(d, 7)).otherwise(d)).otherwise(d)

    def timed(x: Column) -> Column:
        d = rolled(x["s"])
        start = plus(d, F.col("_at"))
        same_day = F.when(F.col("_to") > F.col("_at"), plus(d, F.col("_to"))).otherwise(plus(F.date_add(d, 1), F.col("_to")))
        end = F.when(F.col("_to").isNotNull(), F.when(ends.isNotNull(), plus(ends["s"], F.col("_to"))).otherwise(same_day))
        late = F.col("_bound") == "trước"
        return F.when(late, _occurrence(d, start, F.lit("start"), F.lit(False))).otherwise(_occurrence(start, end, F.when(F.col("_bound") == "sau", "end"), F.lit(False)))

    def whole(x: Column) -> Column:
        bare = F.col("_f_dom").isNotNull() & F.col("_f_year").isNull()  # a range that today lies in began before
        turned = ends["e"] <= x["s"]
        start = F.when(turned & bare, F.add_months(x["s"], F.when(F.col("_f_month").isNull(), -1).otherwise(-12))).otherwise(x["s"])
        end = F.when(ends.isNotNull(), F.when(turned & ~bare, F.add_months(ends["e"], 12)).otherwise(ends["e"])).when(F.datediff(x["e"], x["s"]) > 1, x["e"])
        return _occurrence(start, end, nothing, F.lit(True))

    parted = lambda x: _occurrence(plus(x["s"], starts_at), plus(x["s"], ends_at), nothing, F.lit(False))
    now = F.array(F.struct(today.alias("s"), F.date_add(today, 1).alias("e")))
    days = F.coalesce("_p", now)
    anchored = F.when(clock, F.transform(days, timed)).when(F.col("_f_part").isNotNull(), F.transform(days, parted)).when(dated, F.transform(days, whole))
    rows = rows.withColumn("_events", F.when(F.col("_f").isin(NOW_WORDS), F.array(_occurrence(ref, none, nothing, F.lit(False)))).otherwise(anchored))
    sign = F.when(F.col("_dir") == "trước", -1.0).otherwise(1.0)
    zone_name = F.col(zone) if zone else None
    from_ = F.when(F.col("_rest").isNull(), ref).otherwise(F.get("_events", F.lit(0))["start"])
    day_unit = ~F.col("_u1").isin("hour", "minute", "second")
    rows = rows.withColumn("_base", from_).withColumn("_all", F.coalesce(F.get("_events", F.lit(0))["all_day"] & F.col("_rest").isNotNull() & day_unit, F.lit(False)))
    rows = rows.withColumn("_moved", shifted(F.col("_base"), sign * F.col("_n1"), F.col("_u1"), zone_name))
    rows = rows.withColumn("_moved", F.when(F.col("_u2").isNull(), F.col("_moved")).otherwise(shifted(F.col("_moved"), sign * F.col("_n2"), F.col("_u2"), zone_name)))
    lasting = shifted(ref, F.col("_dn"), F.col("_du"), zone_name)
    keep = lambda a: F.filter(a, lambda x: x["start"].isNotNull())
    events = F.when(F.col("_shift"), F.array(_occurrence(F.col("_moved"), none, nothing, F.col("_all")))).when(F.col("_dn").isNotNull() & lasting.isNotNull(), F.array(_occurrence(ref, lasting, nothing, F.lit(False))))
    return rows.withColumn("_events", keep(events.otherwise(F.col("_events"))))


def _rules(rows: DataFrame, ref: Column, today: Column, zone: str | None) -> DataFrame:
    """Append `_out`, all occurrences, and `_rrule`, the iCalendar text of a rule."""
    unit = lookup(UNITS, take(F.col("_f"), rf"(?:mỗi|mọi|hàng|hằng)(?: \d+)? ({UNIT})(?![\p{{L}}])"))
    has_days = F.size("_f_dows") > 0
    freq = F.when(unit == "week", "WEEKLY").when(unit == "month", "MONTHLY").when(unit == "year", "YEARLY").when(has_days | (F.col("_f_group").isNotNull()), "WEEKLY").when(unit == "day", "DAILY")
    rows = rows.withColumn("_freq", F.when(F.col("_rule"), freq)).withColumn("_interval", F.coalesce(number(F.col("_f"), rf"(?:mỗi|mọi) (\d+) (?:{UNIT})"), F.lit(1)))
    out = F.transform(F.regexp_extract_all("_except", F.lit(EDGE % alternatives(WEEKDAYS)), F.lit(0)), lambda w: lookup(WEEKDAYS, w))
    group = F.when(F.col("_f_group") == "weekend", F.array(F.lit(5), F.lit(6))).when(F.col("_f_group") == "weekday", F.array(*[F.lit(i) for i in range(5)]))
    some = F.when(has_days, F.array_sort("_f_dows")).otherwise(group)
    some = F.when(F.col("_except").isNotNull() & (F.size(out) > 0), F.array_except(F.coalesce(some, F.array(*[F.lit(i) for i in range(7)])), out)).otherwise(some)
    some = F.when(some.isNull() & (F.col("_freq") == "WEEKLY"), F.array(F.weekday(today))).otherwise(some)
    rows = rows.withColumn("_by_day", some).withColumn("_until", F.when(F.col("_rule") & F.col("_l").isNotNull(), F.date_sub(F.get("_lp", F.lit(0))["e"], 1)))
    offset = F.coalesce("_at", _hours(F.col("_f_part"), 0), F.lit(0))
    timed = F.col("_at").isNotNull() | F.col("_f_part").isNotNull()
    plus = lambda d, s: F.timestamp_add("SECOND", s, d.cast("timestamp_ntz"))
    rows = rows.withColumn("_days", F.when(F.col("_freq").isNotNull(), F.filter(rule_days(today), lambda d: ~timed | (plus(d, offset) >= ref))))
    rows = rows.withColumn("_days", spaced(F.col("_days"))).withColumn("_days", F.when(F.col("_count").isNotNull(), F.slice("_days", 1, F.greatest("_count", F.lit(1)))).otherwise(F.col("_days")))
    length = F.coalesce(F.col("_to") - F.col("_at"), F.when(F.col("_at").isNull(), _hours(F.col("_f_part"), 1) - _hours(F.col("_f_part"), 0)))
    length = F.when(length <= 0, length + 86_400).otherwise(length)
    made = F.transform("_days", lambda d: _occurrence(plus(d, offset), plus(d, offset + length), F.lit(None), ~timed))
    rows = rows.withColumn("_out", F.when(F.col("_rule"), made).otherwise(F.col("_events")))
    first = F.get("_days", F.lit(0))
    at = plus(first, offset)
    names = F.transform("_by_day", lambda w: F.get(F.array(*[F.lit(n) for n in recurrence.DAYS]), w))
    zone = F.col(zone) if zone else F.lit(HOME)
    start = F.when(timed, F.concat(F.lit("DTSTART;TZID="), zone, F.lit(":"), F.date_format(at, "yyyyMMdd'T'HHmmss"))).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(first, "yyyyMMdd")))
    opt = lambda cond, *x: F.when(cond, F.concat(*x))
    parts = [
        F.concat(F.lit("RRULE:FREQ="), F.col("_freq")), F.concat(F.lit("INTERVAL="), F.col("_interval")), opt(F.col("_by_day").isNotNull() & ~((F.col("_freq") == "WEEKLY") & ~has_days & group.isNull() & F.col("_except").isNull()), F.lit("BYDAY="), F.array_join(names, ",")),
        opt((F.col("_freq") == "YEARLY") & F.col("_f_month").isNotNull(), F.lit("BYMONTH="), F.col("_f_month")), opt(F.col("_freq").isin("MONTHLY", "YEARLY") & F.col("_f_dom").isNotNull(), F.lit("BYMONTHDAY="), F.col("_f_dom")),
        opt(F.col("_f_nth").isNotNull() & (F.col("_freq") == "MONTHLY"), F.lit("BYSETPOS="), F.col("_f_nth")), opt(F.col("_count").isNotNull(), F.lit("COUNT="), F.col("_count")),
        opt(F.col("_until").isNotNull(), F.lit("UNTIL="), F.date_format("_until", "yyyyMMdd")),
    ]
    return rows.withColumn("_rrule", F.when(F.col("_rule") & first.isNotNull(), F.concat(start, F.lit("\n"), F.concat_ws(";", *parts))))
