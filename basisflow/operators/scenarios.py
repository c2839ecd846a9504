"""Trade generators, their physical metrics and best/worst selections.

Draws are hashes of (seed, keys), so a generator gives the same trades whatever the partitioning
and after any retry.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basisflow.functions.core import EPOCH_ORDINAL, hex_number, hex_text, month_key, short_sha1, uniform_int
from basisflow.functions.digest import md5_words, sha1_words
from basisflow.operators.windows import MIN_REALIZED, bounds, by_scenario, realise_end, unfold
from basisflow.plans.lineage import written

# ---- fixed values ----
BASELINE_DAYS, BASELINE_BBL = 20, 1_000_000
HORIZON, VOLUME = (20, 40), (500_000, 1_500_000)
TRADES_PER_MONTH = {"SMALL": (1, 3), "MEDIUM": (4, 8), "LARGE": (9, 15)}
CANDIDATES_PER_DAY = 10
MONTHLY_BOUNDS = (3, 10)
MONTHS_A_TASK = 100_000  # months of companies, each of up to 15 trades
NO_DAY = -(1 << 40)
# ---- end of fixed values ----


def scenario_id(exposure: Column, kind: Column, start: Column, end: Column, volume: Column,
                company: Column | None = None, pool: Column | None = None, candidate: Column | None = None) -> Column:
    none = F.lit("")
    return short_sha1(20, exposure, kind, start, end, volume.cast("long"), company if company is not None else none,
                      pool if pool is not None else none, candidate if candidate is not None else F.lit(0))


def record_id(sid: Column, series: Column) -> Column:
    return short_sha1(24, sid, series)


def with_ids(t: DataFrame, kind: str, company: bool = False, pool: str | None = None) -> DataFrame:
    return t.withColumns({
        "scenario_kind": F.lit(kind),
        "scenario_id": scenario_id(F.col("exposure_id"), F.lit(kind), F.col("start_date"), F.col("end_date"),
                                   F.col("volume_bbl"), F.col("company_id") if company else None,
                                   F.lit(pool) if pool else None, F.lit(1) if pool else None)})


def baseline(starts: DataFrame, days: DataFrame) -> DataFrame:
    """One trade of fixed size and length from each valid start day."""
    t = starts.select("exposure_id", F.col("d").alias("start_date"), F.lit(BASELINE_DAYS).alias("horizon_days_target"),
                      F.lit(BASELINE_BBL).cast("long").alias("volume_bbl"))
    ok = realise_end(t, days).where(F.col("data_coverage_flag") != "REJECTED")
    return with_ids(ok, "baseline")


def universe(starts: DataFrame, days: DataFrame, seed: str, per_day: int = CANDIDATES_PER_DAY) -> DataFrame:
    """Random (horizon, volume) candidates from each valid start day."""
    t = starts.select("exposure_id", F.col("d").alias("start_date"), F.explode(F.sequence(F.lit(1), F.lit(per_day))).alias("k"))
    key = [F.lit(seed), F.col("exposure_id"), F.col("start_date"), F.col("k")]
    t = t.withColumns({"horizon_days_target": uniform_int(*HORIZON, *key, F.lit("H")).cast("int"),
                       "volume_bbl": uniform_int(*VOLUME, *key, F.lit("Q"))})
    ok = realise_end(t, days).where(F.col("data_coverage_flag") != "REJECTED")
    return with_ids(ok, "oracle_universe", pool="UNIVERSE")


def exact_end(days: DataFrame, start: str, end: str, hold: Column, volume: Column, stride: int = 1) -> DataFrame:
    """Trades from every ``stride``-th calendar day of a range that is a day of the exposure, kept if the day ``hold`` later is one, too.

    Start and end are looked up by equi-join; nothing is shortened.
    """
    d = days.select("exposure_id", "d").where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    on_grid = F.pmod(F.datediff("d", F.lit(start).cast("date")), F.lit(max(stride, 1))) == 0
    t = d.where(on_grid).withColumnRenamed("d", "start_date").withColumn("hold", hold.cast("int"))
    t = t.withColumns({"end_date": F.date_add("start_date", F.col("hold")), "volume_bbl": volume.cast("double")})
    return t.join(d.withColumnRenamed("d", "end_date"), ["exposure_id", "end_date"], "left_semi")


def randomised(days: DataFrame, start: str, end: str, seed: str, hold: tuple[int, int] = (20, 40), volume: tuple[int, int] = (1_000_000, 2_000_000),
               stride: int = 1) -> DataFrame:
    """``exact_end`` with holding days and volume drawn from hashes of (seed, exposure, start)."""
    key = [F.lit(seed), F.col("exposure_id"), F.col("start_date")]
    return exact_end(days, start, end, uniform_int(*hold, *key, F.lit("H")), uniform_int(*volume, *key, F.lit("Q")), stride)


def _month_days(starts: DataFrame) -> DataFrame:
    """(exposure_id, month, days): the valid days of each month in order, as texts, which the hashes need."""
    months = starts.groupBy("exposure_id", month_key(F.col("d")).alias("month")).agg(
        F.array_sort(F.collect_list("d")).cast("array<string>").alias("days"))
    return written(months, "month_days")  # Spark broadcasts it or not by its true size


def _meet(companies: DataFrame, months: DataFrame) -> DataFrame:
    """Every company with every month of its exposure, in as many tasks as keep each at about ``MONTHS_A_TASK``."""
    each = months.groupBy("exposure_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(int(companies.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-companies.count() * each // MONTHS_A_TASK))
    return companies.repartition(parts, "company_id").join(months, "exposure_id")


def _month_digest(seed: str, use) -> Column:
    """``use`` of the digest of a company and month, 128 hex digits: four for each of up to 32 days. As a variable of the outer lambda it is computed once, not for each day."""
    text = lambda n: F.sha2(F.concat_ws("|", F.lit(seed), F.col("company_id"), F.col("month"), F.lit(n)).cast("binary"), 256)
    return F.get(F.transform(F.array(F.concat(text("1"), text("2"))), use), 0)


_TOO_MANY = "a month with over 32 days: its digest has no draw for all"


def company_trades(companies: DataFrame, starts: DataFrame, days: DataFrame, seed: str) -> DataFrame:
    """Trades per company and month on distinct start days.

    A company (company_id, company_size, exposure_id) meets the short list of valid days of each month
    by equi-join on its exposure and picks its days by hash order inside that list, so the number of
    companies only adds rows, never group size. The outer explode
    keeps Catalyst from computing the pick a second time as a filter; a pick is never empty.
    """
    t = _meet(companies, _month_days(starts))
    pick = F.lit(None).cast("long")
    for size, (lo, hi) in TRADES_PER_MONTH.items():
        pick = F.when(F.col("company_size") == size,
                      uniform_int(lo, hi, F.lit(seed), F.col("company_id"), F.col("month"), F.lit("N"))).otherwise(pick)
    t = t.where(F.size("days") <= F.when(F.size("days") > 32, F.raise_error(F.lit(_TOO_MANY))).otherwise(32))
    draws = _month_digest(seed, lambda g: F.transform("days", lambda d, i: F.substring(g, i * 4 + 1, 4)))
    ordered = F.sort_array(F.arrays_zip(draws.alias("h"), F.col("days")))  # by the digits, then by the date
    t = t.withColumn("chosen", F.slice(ordered, F.lit(1), F.least(pick, F.size("days")).cast("int")))
    t = t.select("exposure_id", "company_id", "company_size", "month", F.explode_outer("chosen").alias("c"))
    t = t.select("exposure_id", "company_id", "company_size", "month", F.col("c.days").alias("start_text"))
    k = [F.lit(seed), F.col("company_id"), F.col("start_text")]
    t = t.withColumns({"start_date": F.col("start_text").cast("date"), "horizon_days_target": uniform_int(*HORIZON, *k, F.lit("H")).cast("int"),
                       "volume_bbl": uniform_int(*VOLUME, *k, F.lit("Q"))})
    named = written(days.withColumn("end_text", F.col("trade_d").cast("string")), "day_texts")
    ok = realise_end(t, named, more=("end_text",)).where(F.col("data_coverage_flag") != "REJECTED")
    sid = scenario_id(F.col("exposure_id"), F.lit("company"), F.col("start_text"), F.col("end_text"), F.col("volume_bbl"), F.col("company_id"))
    return ok.withColumns({"scenario_kind": F.lit("company"), "scenario_id": sid}).drop("start_text", "end_text")


def company_totals(companies: DataFrame, starts: DataFrame, days: DataFrame, seed: str) -> DataFrame:
    """Sums of ``company_trades`` for each company, and the first and last scenario id, without a row per trade.

    The digests of trades are most of the work; NumPy makes them for all trades of a batch of months at once (``functions/digest.py``), which
    are summed on the spot. A company that is listed several times is drawn once and counted as often.
    """
    keys = ["company_id", "company_size", "exposure_id"]
    months = _month_days(starts)
    draws = _month_digest(seed, F.unhex)
    t = _meet(companies.groupBy(*keys).agg(F.count("*").alias("times")), months.select("exposure_id", "month")).select(*keys, "times", "month", draws.alias("draws"))
    of_month, ends = _tables(months, days)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _totals(seed, batch, of_month, ends)
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.string()] * 3 + [pa.int64()] * 5 + [pa.string()] * 2, strict=True)],
                                                 [*keys, "times", "n_trades", "n_months", "volume", "horizon", "first_id", "last_id"])

    sums = t.mapInArrow(run, "company_id string, company_size string, exposure_id string, times long, n_trades long, n_months long, volume long, horizon long, first_id string, last_id string")
    total = lambda c: F.sum(F.col(c) * F.col("times")).alias(c)
    low, high = F.min(hex_number(F.col("first_id"), 20)), F.max(hex_number(F.col("last_id"), 20))
    return sums.groupBy(*keys).agg(total("n_trades"), F.sum("n_months").alias("n_months"), total("volume"), total("horizon"),
                                   hex_text(low, 20).alias("first_id"), hex_text(high, 20).alias("last_id"))


def _tables(months: DataFrame, days: DataFrame) -> tuple[tuple, dict]:
    """Days of all months, one after the other: (exposure, month) -> month number; first day and days of each month; number and text of each day.

    By exposure: first calendar day, and number and text of the trading day of each. Exposures times days at most.
    """
    number = lambda d: d.toordinal() - EPOCH_ORDINAL
    matrix = lambda texts: np.frombuffer("".join(texts).encode(), np.uint8).reshape(-1, 10)
    of_month, ends = months.collect(), {}
    length = np.array([len(r["days"]) for r in of_month], np.int64)
    if (length > 32).any():
        raise ValueError(_TOO_MANY)
    every = [d for r in of_month for d in r["days"]]
    listed = ({(r["exposure_id"], r["month"]): i for i, r in enumerate(of_month)}, np.cumsum(length) - length, length,
              np.array([number(date.fromisoformat(d)) for d in every], np.int64), matrix(every))
    of_day = days.groupBy("exposure_id").agg(F.array_sort(F.collect_list(F.struct("cal_d", "trade_d"))).alias("map"))
    for r in of_day.collect():
        first = number(r["map"][0]["cal_d"])
        if [number(x["cal_d"]) - first for x in r["map"]] != list(range(len(r["map"]))):
            raise ValueError(f"days of {r['exposure_id']} have gaps or repeat")
        ends[r["exposure_id"]] = (first, np.array([number(x["trade_d"]) if x["trade_d"] else NO_DAY for x in r["map"]]), matrix(str(x["trade_d"] or "0000-00-00") for x in r["map"]))
    return listed, ends


def _beside(*parts: np.ndarray | str, n: int) -> np.ndarray:
    """Byte matrices and constant texts side by side."""
    flat = [np.broadcast_to(np.frombuffer(p.encode(), np.uint8), (n, len(p.encode()))) if isinstance(p, str) else p for p in parts]
    return np.concatenate(flat, axis=1)


def _drawn(lo, hi, words: np.ndarray) -> np.ndarray:
    """``uniform_int`` from digests: 15 hex digits of an MD5."""
    w = words.astype(np.int64)
    return (w[0] << 28 | w[1] >> 4) % (hi - lo + 1) + lo


def _totals(seed: str, batch: pa.RecordBatch, listed: tuple, ends: dict) -> list[tuple]:
    """(company, size, exposure, times, trades, months, volume, horizon, first id, last id) of the runs of months of one company that have trades."""
    if not len(batch):
        return []
    keys = ["company_id", "company_size", "exposure_id"]
    coded = {c: batch.column(c).dictionary_encode(null_encoding="encode") for c in (*keys, "month")}
    codes = {c: x.indices.to_numpy() for c, x in coded.items()}
    new = np.ones(len(batch), bool)
    new[1:] = np.logical_or.reduce([codes[c][1:] != codes[c][:-1] for c in keys])
    head = np.flatnonzero(new)
    names, sizes, places, times = (batch.column(c).take(pa.array(head)).to_pylist() for c in (*keys, "times"))
    # runs of one exposure and length of the id lie together: their texts have one length
    raw = [(x or "").encode() for x in names]
    order = np.array(sorted(range(len(head)), key=lambda g: (places[g], len(raw[g]))))
    size = np.diff(np.append(head, len(batch)))[order]
    run = np.repeat(np.arange(len(order)), size)
    row = np.arange(len(batch)) + np.repeat(head[order] - (np.cumsum(size) - size), size)
    kind = [(places[g], len(raw[g])) for g in order]
    cut = [0, *[i for i in range(1, len(kind)) if kind[i] != kind[i - 1]], len(kind)]
    groups = [(kind[a][0], a, b, np.frombuffer(b"".join(raw[g] for g in order[a:b]), np.uint8).reshape(b - a, kind[a][1])) for a, b in zip(cut, cut[1:], strict=False)]

    # days of each row: those with the smallest draws, as many as its size asks for
    _, bounds_, values = batch.column("draws").buffers()
    skip = np.frombuffer(bounds_, np.int32)[batch.column("draws").offset]
    drawn = np.frombuffer(values, np.uint8)[skip:skip + 64 * len(batch)].reshape(-1, 64)[row].view(">u2").astype(np.uint32) << 8 | np.arange(32, dtype=np.uint32)
    number, begin, length, day_number, day_text = listed
    known_months = coded["month"].dictionary.to_pylist()
    slot = np.array([[number.get((p, m), -1) for m in known_months] for p in coded["exposure_id"].dictionary.to_pylist()])[codes["exposure_id"][row], codes["month"][row]]
    length = length[slot]
    drawn[np.arange(32) >= length[:, None]] = 1 << 31
    drawn.sort(axis=1)
    month = np.frombuffer("".join(known_months).encode(), np.uint8).reshape(len(known_months), -1)[codes["month"][row]]
    at = lambda index, a, b: slice(*np.searchsorted(index, [a, b]))
    texts = []
    for _, a, b, name in groups:
        s = at(run, a, b)
        texts.append(_beside(f"{seed}|", name[run[s] - a], "|", month[s], "|N", n=s.stop - s.start))
    least, most = (np.array([TRADES_PER_MONTH.get(sizes[g], (32, 32))[k] for g in order])[run] for k in (0, 1))
    wanted = np.minimum(_drawn(least, most, md5_words(*texts)), length)
    picked = np.arange(32) < wanted[:, None]
    r = np.repeat(np.arange(len(row)), wanted)
    i = (drawn[picked] & 255).astype(np.int64) + begin[slot][r]
    start, day = day_number[i], day_text[i]

    owner = run[r]
    texts = []
    for what in "HQ":
        for _, a, b, name in groups:
            s = at(owner, a, b)
            texts.append(_beside(f"{seed}|", name[owner[s] - a], "|", day[s], f"|{what}", n=s.stop - s.start))
    words = md5_words(*texts)
    horizon, volume = _drawn(*HORIZON, words[:, :len(r)]), _drawn(*VOLUME, words[:, len(r):])
    end, end_text = np.full(len(r), NO_DAY), np.zeros((len(r), 10), np.uint8)
    for place, a, b, _ in groups:
        if place in ends:
            d0, number, text = ends[place]
            s = at(owner, a, b)
            target = start[s] + horizon[s] - d0
            known = (target >= 0) & (target < len(number))
            target = np.where(known, target, 0)
            end[s], end_text[s] = np.where(known, number[target], NO_DAY), text[target]
    ok = np.flatnonzero((end != NO_DAY) & (end - start >= MIN_REALIZED))
    if not len(ok):
        return []
    owner, r, day, horizon, volume, end_text = owner[ok], r[ok], day[ok], horizon[ok], volume[ok], end_text[ok]
    digits = 1 + sum((volume >= 10 ** k).astype(np.int64) for k in range(1, len(str(VOLUME[1]))))
    texts, where = [], []
    for place, a, b, name in groups:
        s = at(owner, a, b)
        for width in np.unique(digits[s]):
            w = s.start + np.flatnonzero(digits[s] == width)
            number = (volume[w, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + 48).astype(np.uint8)
            texts.append(_beside(f"{place}|company|", day[w], "|", end_text[w], "|", number, "|", name[owner[w] - a], "||0", n=len(w)))
            where.append(w)
    sid, where = sha1_words(*texts), np.concatenate(where)
    high, low = np.zeros(len(ok), np.uint64), np.zeros(len(ok), np.int64)
    high[where], low[where] = sid[0].astype(np.uint64) << np.uint64(32) | sid[1], sid[2] >> 16

    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    n = np.diff(np.append(first, len(owner)))
    found = [n, np.add.reduceat(np.concatenate([[1], r[1:] != r[:-1]]), first), np.add.reduceat(volume, first), np.add.reduceat(horizon, first)]
    found = [x.tolist() for x in found]
    for pick, none in ((np.minimum, 1 << 16), (np.maximum, -1)):
        top = pick.reduceat(high, first)
        rest = pick.reduceat(np.where(high == np.repeat(top, n), low, none), first)
        found.append([f"{a:016x}{b:04x}" for a, b in zip(top.tolist(), rest.tolist(), strict=True)])
    of = order[owner[first]].tolist()
    return [(names[g], sizes[g], places[g], times[g], *x) for g, x in zip(of, zip(*found, strict=True), strict=True)]


def price_ends(trades: DataFrame, cal: DataFrame) -> DataFrame:
    """Entry and exit price, physical P&L, return and score; needs no daily rows."""
    s = cal.select("exposure_id", F.col("d").alias("start_date"), F.col("spot").alias("spot_start"))
    e = cal.select("exposure_id", F.col("d").alias("end_date"), F.col("spot").alias("spot_end"))
    t = trades.join(s, ["exposure_id", "start_date"]).join(e, ["exposure_id", "end_date"])
    move = F.col("spot_end") - F.col("spot_start")
    return t.withColumns({"pnl_physical": move * F.col("volume_bbl"), "score_physical": move * F.col("volume_bbl"),
                          "return_simple": F.try_divide(move, F.col("spot_start"))})


def physical_path(trades: DataFrame, cal: DataFrame, days: DataFrame) -> DataFrame:
    """High, low, drawdown, adverse excursion and missed upside over the holding window."""
    b = bounds(trades, cal).select("scenario_id", "exposure_id", "volume_bbl", "pos0", "pos1")
    b = by_scenario(b)
    rows = unfold(b, days, ["spot"])
    w = Window.partitionBy("scenario_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("peak", F.max("spot").over(w))
    q, drop = F.col("volume_bbl"), F.col("spot") - F.col("peak")
    g = rows.groupBy("scenario_id", "exposure_id", "volume_bbl").agg(
        F.min_by("spot", "pos").alias("spot_start"), F.max_by("spot", "pos").alias("spot_end"),
        F.max("spot").alias("spot_high"), F.min("spot").alias("spot_low"), F.min(drop).alias("_dd"),
        F.min(F.when(F.col("peak") > 0, drop / F.col("peak"))).alias("mdd_pct"))
    move = F.col("spot_end") - F.col("spot_start")
    return g.withColumns({
        "pnl_physical": move * q, "return_simple": F.try_divide(move, F.col("spot_start")), "mdd_abs_usd": F.col("_dd") * q,
        "mae_abs_usd": (F.col("spot_low") - F.col("spot_start")) * q,
        "missed_upside_usd": (F.col("spot_high") - F.col("spot_start")) * q - move * q, "score_physical": move * q}).drop("_dd")


def daily_extremes(uni: DataFrame, best: bool = True) -> DataFrame:
    """Best or worst candidate of each start day; ties go to the first one generated."""
    key = F.struct((-F.col("score_physical") if best else F.col("score_physical")), F.col("k"))
    whole = F.struct(*uni.columns)
    t = uni.groupBy("exposure_id", "start_date").agg(F.min_by(whole, key).alias("r")).select("r.*")
    return t.withColumn("oracle_series", F.lit(f"EXTREME_DAILY_{'BEST' if best else 'WORST'}"))


def feasible_monthly(uni: DataFrame, best: bool = True, limits: tuple[int, int] = MONTHLY_BOUNDS) -> DataFrame:
    """The selection a 0/1 programme would make: at most one trade per start day, between lo and hi
    a month, best (worst) total score.

    Only the best candidate of a day can be chosen, and the total splits over days, so the ranking of
    the daily bests solves it exactly: the first lo always, then up to hi while they still help.
    Months with fewer than lo days have no solution and give no row.
    """
    lo, hi = limits
    sign = 1 if best else -1
    d = daily_extremes(uni, best).withColumns({"month": month_key(F.col("start_date")), "_s": F.col("score_physical") * sign})
    m = Window.partitionBy("exposure_id", "month")
    d = d.withColumns({"_rk": F.row_number().over(m.orderBy(F.desc("_s"), "start_date")), "_n": F.count("*").over(m)})
    pick = (F.col("_n") >= lo) & ((F.col("_rk") <= lo) | ((F.col("_rk") <= hi) & (F.col("_s") > 0)))
    return d.where(pick).drop("_s", "_rk", "_n").withColumn(
        "oracle_series", F.lit(f"FEASIBLE_MONTHLY_{'BEST' if best else 'WORST'}"))


def labelled_union(uni: DataFrame) -> DataFrame:
    """All four selections in one table with record ids."""
    parts = [daily_extremes(uni, True), daily_extremes(uni, False), feasible_monthly(uni, True), feasible_monthly(uni, False)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumns({
        "scenario_kind": F.lit("oracle_all"),
        "scenario_record_id": record_id(F.col("scenario_id"), F.col("oracle_series")),
        "scenario_id_with_label": F.concat_ws("__", "scenario_id", "oracle_series")})
