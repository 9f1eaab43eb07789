"""The price tape: valid quotes, sessions, rolling baselines, base rates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import written


def valid_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes with positive last and reference prices; always before any window, so that skipped rows leave no gap."""
    return quotes.where((F.col("last") > 0) & (F.col("ref") > 0))


def latest_of_day(quotes: DataFrame, ts: str = "ts", *, key: str = "cod", tie: str = "id") -> DataFrame:
    """One row for each (key, day): the latest timestamp, the largest `tie` on equal ones."""
    rest = [c for c in quotes.columns if c not in (key, ts, tie)]
    last = quotes.groupBy(key, F.to_date(ts).alias("d")).agg(F.max(F.struct(ts, tie, *rest)).alias("_x"))
    return last.select(key, "d", "_x.*")


def sessions(quotes: DataFrame, *, codes: DataFrame | None = None) -> DataFrame:
    """Valid quotes with prev_ref, ret = last / prev_ref - 1 and idx, the 1-based session number of the instrument."""
    rows = valid_quotes(quotes)
    if codes is not None:
        rows = rows.join(codes.select("cod").distinct(), "cod", "left_semi")
    w = Window.partitionBy("cod").orderBy("d")
    rows = rows.withColumn("prev_ref", F.lag("ref").over(w)).withColumn("idx", F.row_number().over(w))
    return rows.withColumn("ret", F.try_divide("last", "prev_ref") - 1)


def rolling(rows: DataFrame, lo: int, hi: int, suffix: str, *, key: str = "cod", order: str = "idx", value: str = "ret") -> DataFrame:
    """Count and sample deviation of `value` over a frame of rows, as n_<suffix> and sd_<suffix>."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(lo, hi)
    return rows.withColumns({f"n_{suffix}": F.count(value).over(w), f"sd_{suffix}": F.stddev_samp(value).over(w)})


def unusual(ret: str | Column, sd: str | Column, k: float = 2.0) -> Column:
    return F.abs(F.try_divide(ret, sd)) >= k


def base_rate(rows: DataFrame, *, start: str, n: int = 20, k: float = 2.0) -> DataFrame:
    """Chance of an unusual session with a baseline that includes it (a) or ends before it (b).

    Rows without a return and rows before `start` go first, so the baseline restarts at the start date.
    """
    rows = rows.where((F.col("d") >= F.to_date(F.lit(start))) & F.col("ret").isNotNull())
    rows = rolling(rolling(rows, -(n - 1), 0, "a"), -n, -1, "b")
    out = []
    for x in "ab":
        on = F.col(f"n_{x}") == n
        out += [F.count_if(on).alias(f"n_sessions_{x}"), F.count_if(on & unusual("ret", f"sd_{x}", k)).alias(f"n_unusual_{x}")]
    rates = rows.agg(*out)
    return rates.withColumns({f"share_{x}": F.try_divide(f"n_unusual_{x}", f"n_sessions_{x}") for x in "ab"})


def trailing_z(rows: DataFrame, start: str, end: str, *, n: int = 20) -> DataFrame:
    """z against the n moves before each session, over full history; the date filter comes last."""
    z = F.when(F.col("n_t") == n, F.try_divide("ret", "sd_t"))
    return rolling(rows, -n, -1, "t").withColumn("z", z).where(F.col("d").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def universe(names: DataFrame, quotes: DataFrame, *, stop: list[str] | None = None, shortest: int = 3) -> DataFrame:
    """Ordinary Italian shares with a usable name and at least one quote; `stop` lists names that are common words."""
    rows = names.where((F.col("kind") == "ORD") & F.col("isin").startswith("IT") & (F.length(F.trim("name")) >= shortest))
    if stop:
        rows = rows.where(~F.upper(F.trim("name")).isin([s.upper() for s in stop]))
    return rows.join(quotes.select("cod").distinct(), "cod", "left_semi")


def name_pattern(name: str | Column) -> Column:
    """A regular expression for a whole name: its first letter as written (either case if lower), the rest in any case."""
    name = F.trim(name)
    escaped = lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    first, rest = F.substring(name, 1, 1), name.substr(F.lit(2), F.length(name))
    head = F.when(first == F.upper(first), escaped(first)).otherwise(F.concat(F.lit("["), F.upper(first), first, F.lit("]")))
    return F.concat(F.lit("(?<![0-9A-Za-z_])"), head, F.lit("(?i:"), escaped(rest), F.lit(")(?![0-9A-Za-z_])"))


#: A token of a text or a name: a run of word characters, or one other character that is no white space.
TOKEN = r"[0-9A-Za-z_]+|[^0-9A-Za-z_\s]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: str | Column) -> Column:
    """The tokens of a text in order, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def name_candidates(articles: DataFrame, names: DataFrame, *, text: str = "title") -> DataFrame:
    """(id, cod, pattern) where all tokens of a name follow each other in a text: an equi-join on token runs of the lengths that names have."""
    named = names.select("cod", name_pattern("name").alias("pattern"), tokens("name").alias("_t")).where(F.size("_t") > 0)
    named = named.select("cod", "pattern", F.size("_t").alias("_n"), F.array_join("_t", " ").alias("run"))
    lengths = named.agg(F.collect_set("_n").alias("lengths"))
    texts = articles.select("id", tokens(text).alias("_t")).crossJoin(F.broadcast(lengths))  # one row
    starts = lambda n: F.filter(F.sequence(F.lit(1), F.greatest(F.size("_t") - n + 1, F.lit(1))), lambda i: i + n <= F.size("_t") + 1)
    runs = F.flatten(F.transform("lengths", lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice("_t", i, n), " "))))
    return texts.select("id", F.explode(F.array_distinct(runs)).alias("run")).join(named.drop("_n"), "run").select("id", "cod", "pattern")


def match_names(articles: DataFrame, names: DataFrame, *, text: str = "title") -> DataFrame:
    """(id, cod) for each name found in each text.

    Names and texts meet on whole token runs, however many names share a word, so that the pairs that meet are hardly more
    than the matches themselves; case and spacing are tested by the pattern on those pairs.
    """
    met = name_candidates(articles, names, text=text)
    return met.join(articles.select("id", F.col(text).alias("t")), "id").where("t rlike pattern").select("id", "cod").distinct()


def one_company(matches: DataFrame) -> DataFrame:
    """Matches of articles that name exactly one company."""
    one = matches.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("cod").alias("cod")).where("n = 1")
    return one.select("id", "cod")


def publication(articles: DataFrame, *, zone: str = "Europe/Rome", live: str = "^Live blog") -> DataFrame:
    """Articles without live blogs, with local publication time and date."""
    local = F.expr(f"convert_timezone('UTC', '{zone}', pub_utc)")
    return articles.where(~F.col("title").rlike(live)).withColumn("pub_local", local).withColumn("pub_date", F.to_date("pub_local"))


def articles_in(articles: DataFrame, *, ids: list[str] | DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The articles of a list or table of ids if there is one, else those of a range of local dates."""
    if isinstance(ids, DataFrame):
        return articles.join(ids.select("id"), "id", "left_semi")
    if ids:
        return articles.where(F.col("id").isin(ids))
    return articles.where(F.col("pub_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def anchor(articles: DataFrame, rows: DataFrame, *, date: str = "pub_date", carry: Sequence[str] = (), latest: Sequence[str] = ()) -> DataFrame:
    """Add idx_before, the last session strictly before the date, and that session's `carry` columns; articles before the first session go.

    Of `latest` columns, the last value up to that session that is not null. Sessions and articles are sorted together once
    for each instrument, articles first on an equal date. Sessions are dealt by instrument already, so only the articles are
    shuffled, and what is carried needs no join.
    """
    a = articles.repartition("cod").withColumn("_at", F.col(date)).withColumn("_kind", F.lit(0))
    s = rows.select("cod", F.col("d").alias("_at"), F.lit(1).alias("_kind"), F.struct(F.col("idx").alias("idx_before"), *carry).alias("_s"), *latest)
    w = Window.partitionBy("cod").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(s, allowMissingColumns=True).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("_s", *latest)})
    return both.where("_kind = 0 and _s is not null").select(*articles.columns, "_s.*", *latest)


def ahead(rows: DataFrame, fields: Sequence[str], n: int, *, block: int = 8) -> DataFrame:
    """rows with _ahead, on the first of every `block` sessions of an instrument: idx and `fields` of the block's sessions and the n after them; null on others.

    The last _ahead up to a session holds that session and the n after it, and takes the room of (block + n) / block sessions on each.
    """
    w = Window.partitionBy("cod").orderBy("d").rowsBetween(0, block - 1 + n)
    first = F.col("idx") % block == F.lit(1 % block)
    return rows.withColumn("_ahead", F.when(first, F.collect_list(F.struct("idx", *fields)).over(w)))


def onward(found: DataFrame, n: int) -> DataFrame:
    """found with the fields of its _ahead for the session before the article and the n after it, a row for each."""
    inside = F.filter("_ahead", lambda s: s["idx"].between(F.col("idx_before"), F.col("idx_before") + n))
    return found.select(*[c for c in found.columns if c != "_ahead"], F.inline(inside))


#: What `baseline` adds to sessions.
BASE = ["n_base", "sd", "avg_qty", "base_from", "base_to"]


def baseline(rows: DataFrame, *, n: int = 20) -> DataFrame:
    """Sessions with the statistics of the n sessions up to each: n_base, sd, avg_qty, base_from, base_to."""
    w = Window.partitionBy("cod").orderBy("d").rowsBetween(-(n - 1), 0)
    return rows.withColumns({"n_base": F.count("ret").over(w), "sd": F.stddev_samp("ret").over(w), "avg_qty": F.avg("qty").over(w), "base_from": F.min("d").over(w), "base_to": F.max("d").over(w)})


def spread(found: DataFrame, rows: DataFrame, fields: Sequence[str], lo: Column, hi: Column, *, keep: Callable[[Column], Column] | None = None, block: int = 32) -> DataFrame:
    """found with idx and `fields` of each session of its instrument from position lo to hi, a row for each.

    Sessions meet as blocks of consecutive ones, and blocks are joined on the instrument alone, within the first and the
    last that lo and hi fall in: both sides stay where the instrument is, and nothing that is spread is shuffled or sorted.
    keep picks among the positions.
    """
    blocks = rows.groupBy(F.col("cod").alias("_cod"), F.floor(F.col("idx") / block).alias("_block")).agg(F.collect_list(F.struct("idx", *fields)).alias("_sessions"))
    at = found.withColumns({"_lo": lo, "_hi": hi})
    near = (F.col("cod") == F.col("_cod")) & (F.col("_block") >= F.floor(F.col("_lo") / block)) & (F.col("_block") <= F.floor(F.col("_hi") / block))
    inside = lambda s: s["idx"].between(F.col("_lo"), F.col("_hi")) & (F.lit(True) if keep is None else keep(s["idx"]))
    return at.join(blocks, near).select(*found.columns, F.inline(F.filter("_sessions", inside)))


def usable_open() -> Column:
    """The open if positive and, where low and high are valid, within them but for a ten-thousandth; else null."""
    inside = F.col("open").between(F.col("low") * 0.9999, F.col("high") * 1.0001)
    return F.when((F.col("open") > 0) & (~((F.col("low") > 0) & (F.col("high") > 0)) | inside), F.col("open"))


def phase(articles: DataFrame, trading: Column, *, opens: str = "09:00:00", closes: str = "17:30:00") -> DataFrame:
    """Add phase: non_trading_day, pre_open, in_session or after_close at the local publication time; trading says whether the day is one of sessions."""
    t = F.date_format("pub_local", "HH:mm:ss")
    name = F.when(~F.coalesce(trading, F.lit(False)), "non_trading_day").when(t < opens, "pre_open").when(t < closes, "in_session").otherwise("after_close")
    return articles.withColumn("phase", name)


def tape(articles: DataFrame, names: DataFrame, quotes: DataFrame, *, one: DataFrame | None = None, final: DataFrame | None = None, n: int = 20, later: int = 5, k: float = 2.0) -> DataFrame:
    """One row for each (article, session) from the day before to the fifth later session, with its flags.

    All steps keep to the instrument: an article takes from the session before it the baseline, the day of the next
    session, which tells whether it was published on a trading day, the last close and the sessions that follow.
    So quotes and articles are shuffled by instrument once and the rows of the tape are not. The matches, given as `one` if
    they are at hand, are read several times and so are written once. final has one row with final_d, the last day of the
    raw quotes; with it, quotes are read once.
    """
    one = written(one_company(match_names(publication(articles), names))) if one is None else one
    rows = sessions(quotes, codes=one)
    w = Window.partitionBy("cod").orderBy("d")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = baseline(rows, n=n).withColumns({"_next": F.lead("d").over(w), "_end": F.last(F.struct("d", "last")).over(whole)})
    fields = ["d", "last", "ref", "prev_ref", "ret", "qty", "open", "low", "high"]
    found = anchor(publication(articles.join(one, "id")), ahead(marked, fields, later + 1), carry=[*BASE, "_next", "_end"], latest=["_ahead"]).where(F.col("n_base") == n)
    on_day = F.coalesce(F.col("_next") == F.col("pub_date"), F.lit(False))
    found = phase(found, on_day).withColumn("_same", on_day.cast("int"))
    t = onward(found, later + 1)
    timing = F.when(F.col("d") < F.col("pub_date"), "day_before").when(F.col("d") == F.col("pub_date"), "same_day").otherwise("later")
    t = t.withColumn("timing", timing).withColumn("open_px", usable_open())
    after = F.col("d") > F.col("pub_date")
    # later sessions are consecutive, so their rank is a difference of positions
    t = t.withColumn("later_rank", F.when(after, F.col("idx") - F.col("idx_before") - F.col("_same"))).where(~after | (F.col("later_rank") <= later))
    z = F.try_divide("ret", "sd")
    t = t.withColumns({
        "z": z,
        "unusual": F.abs(z) >= k,
        "gap": F.try_divide("open_px", "prev_ref") - 1,
        "intraday": F.try_divide("last", "open_px") - 1,
        "open_share": F.try_divide(F.ln(F.try_divide("open_px", "prev_ref")), F.ln(F.try_divide("last", "prev_ref"))),
        "vol_x": F.try_divide("qty", "avg_qty"),
        "closed_before": (F.col("d") < F.col("pub_date")) | ((F.col("timing") == "same_day") & (F.col("phase") == "after_close")),
        "is_reaction": F.when(F.col("phase").isin("pre_open", "in_session"), F.col("timing") == "same_day").otherwise(F.coalesce(F.col("later_rank") == 1, F.lit(False))),
    })
    final = quotes.agg(F.max("d").alias("final_d")) if final is None else final  # one row, over the raw table
    t = t.crossJoin(F.broadcast(final)).withColumn("final_px", F.when(F.col("_end.d") == F.col("final_d"), F.col("_end.last"))).drop("_next", "_end", "_same")
    return t.withColumn("retained", F.try_divide(F.col("final_px") - F.col("prev_ref"), F.col("last") - F.col("prev_ref")))


def event_peaks(articles: DataFrame, names: DataFrame, quotes: DataFrame, *, n: int = 20, later: int = 5) -> DataFrame:
    """The session of largest |z| for each article, by UTC date and always the anchor and later + 1 sessions after it."""
    rows0 = articles.where(~F.col("title").rlike("^Live blog")).withColumn("pub_date", F.to_date("pub_utc"))
    one = written(one_company(match_names(rows0, names)))
    rows = sessions(quotes, codes=one)
    found = anchor(rows0.join(one, "id"), ahead(baseline(rows, n=n), ["d", "ret"], later + 1), carry=BASE, latest=["_ahead"]).where(F.col("n_base") == n)
    t = onward(found, later + 1).withColumn("z", F.try_divide("ret", "sd"))
    w = Window.partitionBy("cod", "id").orderBy(F.abs("z").desc_nulls_last(), "d")
    return t.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def chart_series(articles: DataFrame, names: DataFrame, quotes: DataFrame, *, one: DataFrame | None = None, before: int = 25, after: int = 40, n: int = 20, cutoff: str | None = None, rels: Sequence[int] | None = None) -> DataFrame:
    """Sessions around each article from before to after its anchor, indexed to 100 at the anchor.

    With `rels`, only those of these relative numbers and each article's first.
    """
    one = written(one_company(match_names(publication(articles), names))) if one is None else one
    rows = sessions(quotes, codes=one)
    rows = rows if cutoff is None else rows.where(F.col("d") <= F.to_date(F.lit(cutoff)))
    found = anchor(publication(articles.join(one, "id")), baseline(rows, n=n).withColumn("start_px", F.col("last")), carry=[*BASE, "start_px"])
    lo = F.greatest(F.col("idx_before") - before, F.lit(1))
    keep = None if rels is None else (lambda i: (i == lo) | (i - F.col("idx_before") - 1).isin(*rels))
    t = spread(found, rows, ["d", "last", "ret"], lo, F.col("idx_before") + after, keep=keep)
    return t.withColumns({
        "rel": F.col("idx") - F.col("idx_before") - 1,
        "in_baseline": F.col("idx").between(F.col("idx_before") - (n - 1), F.col("idx_before")),
        "index_100": F.try_divide("last", "start_px") * 100,
        "z": F.try_divide("ret", "sd"),
    })
