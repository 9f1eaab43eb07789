"""The driver's tables in the shapes that the operators take, in Spark and as common table expressions for SQL checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import written

QUOTES = """
SELECT concat('S', cast(l_suppkey as string)) AS cod, cast(l_shipdate as date) AS d,
  CASE WHEN l_suppkey % 10 = 3 AND day(cast(l_shipdate as date)) = 1 THEN 0.0 ELSE sum(l_extendedprice) / sum(l_quantity) END AS last,
  CASE WHEN l_suppkey % 6 = 0 THEN avg(l_extendedprice / l_quantity) ELSE sum(l_extendedprice) / sum(l_quantity) END AS ref,
  CASE WHEN l_suppkey % 7 = 0 THEN 0.0 ELSE (min(l_extendedprice / l_quantity) + max(l_extendedprice / l_quantity)) / 2 END AS open,
  min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high, sum(l_quantity) AS qty
FROM lineitem GROUP BY l_suppkey, cast(l_shipdate as date)"""

NAMES = """
SELECT concat('S', cast(s_suppkey as string)) AS cod, s_name AS name,
  concat(CASE WHEN s_suppkey % 9 = 0 THEN 'NL' ELSE 'IT' END, cast(s_suppkey as string)) AS isin,
  CASE WHEN s_suppkey % 11 = 0 THEN 'ETF' ELSE 'ORD' END AS kind
FROM supplier"""

#: {at} is the publication time in the engine's own interval syntax.
ARTICLES = """
SELECT cast(o_orderkey as string) AS id,
  concat(CASE WHEN o_orderkey % 17 = 0 THEN 'Live blog ' ELSE '' END,
    'Supplier#', lpad(cast(o_custkey % (SELECT count(*) FROM supplier) as string), 9, '0'),
    CASE WHEN o_orderkey % 10 = 0 THEN concat(' and Supplier#', lpad(cast((o_custkey + 1) % (SELECT count(*) FROM supplier) as string), 9, '0')) ELSE '' END,
    ' ', o_orderpriority) AS title,
  {at} AS pub_utc
FROM orders"""
AT_SPARK = "o_orderdate + make_dt_interval(0, 0, 0, (o_orderkey * 7919) % 86400)"
AT_DUCK = "o_orderdate + to_seconds((o_orderkey * 7919) % 86400)"

MEMBERS = """
SELECT r_name AS sector, concat('S', cast(s_suppkey as string)) AS cod
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

POSITIONS = "SELECT concat('S', cast(s_suppkey as string)) AS ticker, cast(s_suppkey * 10 + 5 as double) AS qty FROM supplier WHERE s_acctbal >= 5000"
WATCHLIST = "SELECT concat('S', cast(s_suppkey as string)) AS ticker FROM supplier WHERE s_acctbal < 5000"

#: Every quarter that has orders, numbered in order.
QUARTERS = """
SELECT cast(row_number() OVER (ORDER BY y, q) as int) AS no, concat(cast(y as string), 'Q', cast(q as string)) AS quarter, make_date(cast(y as int), cast(3 * q - 2 as int), 1) AS from_d, last_day(make_date(cast(y as int), cast(3 * q as int), 1)) AS to_d
FROM (SELECT DISTINCT year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders) AS d"""

THESES = """
SELECT concat('S', cast(s_suppkey as string)) AS ticker, concat('growth case ', s_name) AS motive,
  CASE WHEN s_suppkey % 2 = 0 THEN array('URGENT', 'HIGH') ELSE array('MEDIUM', 'LOW') END AS indicators,
  CASE WHEN s_suppkey % 3 = 0 THEN 'long' ELSE 'short' END AS horizon, cast(5 + s_suppkey % 4 as double) AS target_weight
FROM supplier"""

#: An earlier state of the theses, by customers of the same number, and overrides of some fields, null ones among them.
THESES_BEFORE = """
SELECT concat('S', cast(c_custkey as string)) AS ticker, concat('growth case ', s_name) AS motive,
  CASE WHEN c_custkey % 2 = 0 THEN array('URGENT', 'HIGH') ELSE array('MEDIUM', 'LOW') END AS indicators,
  CASE WHEN c_custkey % 3 = 0 THEN 'long' ELSE 'short' END AS horizon, CASE WHEN c_acctbal < 0 THEN NULL ELSE cast(5 + c_nationkey % 4 as double) END AS target_weight
FROM customer JOIN supplier ON c_custkey = s_suppkey"""
OVERRIDES = """
SELECT concat('S', cast(c_custkey as string)) AS ticker, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS motive, c_nationkey % 2 = 0 AS has_motive,
  cast(c_nationkey as double) AS target_weight, c_nationkey % 5 = 0 AS has_weight FROM customer WHERE c_acctbal > 2000"""

#: Rules over the normalised words of titles and bodies: type, number, pattern, soft, hard.
RULES = """
SELECT * FROM (VALUES ('capital', 1, '1-urgent', false, true), ('earnings', 2, 'urgent|high', true, false), ('earnings', 3, '2-high', false, false),
  ('guidance', 4, '3-medium', false, false), ('market_report', 5, '[0-9]-', false, false), ('legal', 6, 'licen[sc]e|copyright', false, false), ('deal', 7, 'token|password', false, false), ('rating', 8, '4-not.{0,20}specified', false, false)) AS r(type, rule_no, pattern, soft, hard)"""
PRIORITY = "SELECT * FROM (VALUES ('capital', 1), ('earnings', 2), ('guidance', 3), ('legal', 4), ('rating', 5), ('deal', 6), ('market_report', 7)) AS p(type, priority)"
#: Each article's body is a document; three proposals a model might make for every article, each with a quote.
BODIES = "SELECT cast(o_orderkey as string) AS id, d.text AS body FROM orders JOIN documents d ON d.doc_id = o_orderkey % (SELECT count(*) FROM documents)"
PROPOSALS = """
SELECT cast(o_orderkey as string) AS id, 1 AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'deal' WHEN 1 THEN 'legal' WHEN 2 THEN 'other' ELSE 'guidance' END AS topic, concat('Says ', o_orderpriority) AS evidence, (o_orderkey % 13) / 10.0 AS confidence FROM orders
UNION ALL SELECT cast(o_orderkey as string), 2, CASE o_orderkey % 3 WHEN 0 THEN 'earnings' WHEN 1 THEN 'market_report' ELSE 'rating' END, CASE WHEN o_orderkey % 5 = 0 THEN 'Closed in LOW spirits' ELSE o_orderpriority END, 0.5 FROM orders
UNION ALL SELECT cast(o_orderkey as string), 3, 'capital', concat('Order ', o_orderpriority), 0.9 FROM orders WHERE o_orderkey % 2 = 0"""

#: The last four quarters, k from 0, and each company's articles in them: documents dealt to companies and quarters by their ids.
RECENT = f"SELECT no, quarter, from_d, to_d, no - m + 3 AS k FROM ({QUARTERS}) AS q CROSS JOIN (SELECT max(no) AS m FROM ({QUARTERS}) AS q) AS x WHERE no > m - 4"
PRESS = f"""
SELECT concat('S', cast(doc_id % n as string)) AS cod, q.no, q.quarter, doc_id AS article_id, concat('Results ', substr(coalesce(text, ''), 1, 30)) AS title, coalesce(text, '') AS body,
  q.from_d + cast(doc_id % 80 as int) AS pub_date, concat('https://', source, '/', cast(doc_id as string)) AS url
FROM documents CROSS JOIN (SELECT count(*) AS n FROM supplier) AS s JOIN ({RECENT}) AS q ON q.k = cast(floor(doc_id / n) as bigint) % 4"""
#: The four quarters go to the documents: a shuffle by quarter would put all bodies into four tasks.
PRESS_SPARK = PRESS.replace("SELECT concat", "SELECT /*+ BROADCAST(q) */ concat", 1)
#: What a model claims of them in two attempts, right and wrong, by kind and position: facts with quotes, metrics, indicators and free texts.
CLAIMS = f"""
SELECT p.cod, p.quarter, p.no, attempt, 'fact' AS kind, 2 * article_id + i AS pos, '' AS name, concat('Reports: ', substr(body, 11, 30), CASE e WHEN 2 THEN ' 987654321.5' WHEN 3 THEN ' total idiot' ELSE '' END) AS text,
  concat(substr(body, 5, 40), CASE e WHEN 1 THEN ' zz' ELSE '' END) AS quote, CASE e WHEN 0 THEN -1 - article_id ELSE article_id END AS article_id, '' AS value, '' AS comparison, '' AS base, '' AS state
FROM (SELECT *, CASE WHEN attempt = 2 AND article_id % 2 = 0 THEN 8 ELSE (2 * article_id + i) % 9 END AS e FROM ({PRESS}) AS p CROSS JOIN (VALUES (1), (2)) AS a(attempt) CROSS JOIN (VALUES (0), (1)) AS f(i)) AS p
UNION ALL SELECT cod, quarter, no, attempt, 'metric', article_id, CASE article_id % 8 WHEN 0 THEN 'Ricavi netti' WHEN 1 THEN 'EBITDA rettificato' WHEN 2 THEN 'EBITDA margin' WHEN 3 THEN 'Utile netto' WHEN 4 THEN 'EPS' WHEN 5 THEN 'Free cash flow' WHEN 6 THEN 'Fatturato' ELSE 'Debito/EBITDA' END,
  '', '', article_id, CASE WHEN article_id % 5 = 0 THEN regexp_extract(body, '[0-9]+', 0) WHEN article_id % 5 = 2 THEN 'never said' WHEN article_id % 5 = 3 AND attempt = 1 THEN '123456.75' ELSE split_part(body, ' ', 1) END,
  CASE WHEN article_id % 7 = 0 THEN '+77.7%' ELSE '' END, CASE article_id % 3 WHEN 0 THEN 'y/y' WHEN 1 THEN 'q/q' ELSE 'vs plan' END, '' FROM ({PRESS}) AS p CROSS JOIN (VALUES (1), (2)) AS a(attempt)
UNION ALL SELECT cod, quarter, no, attempt, 'indicator', article_id, CASE WHEN article_id % 3 = 2 THEN 'STRANGER' WHEN cast(substr(cod, 2) as bigint) % 2 = 0 THEN CASE article_id % 3 WHEN 0 THEN 'URGENT' ELSE 'HIGH' END ELSE CASE article_id % 3 WHEN 0 THEN 'MEDIUM' ELSE 'LOW' END END,
  concat('On ', substr(body, 1, 12), CASE article_id % 7 WHEN 1 THEN ' 987654321.5' WHEN 2 THEN ' clown' ELSE '' END), CASE article_id % 7 WHEN 3 THEN 'not said anywhere' WHEN 4 THEN '' ELSE substr(body, 3, 25) END, CASE article_id % 7 WHEN 5 THEN -1 ELSE article_id END,
  '', '', '', CASE article_id % 5 WHEN 0 THEN 'for' WHEN 1 THEN 'neutral' WHEN 2 THEN 'against' WHEN 3 THEN 'odd' ELSE 'not_cited' END FROM ({PRESS}) AS p CROSS JOIN (VALUES (1), (2)) AS a(attempt)
UNION ALL SELECT cod, quarter, no, attempt, kind, 0, '', CASE kind WHEN 'guidance' THEN CASE WHEN m % 3 = 0 THEN 'Sees 5500.5' WHEN m % 3 = 1 THEN 'null' ELSE ' Sees growth ' END WHEN 'changed' THEN CASE WHEN m % 4 = 0 THEN 'A moron would see it' ELSE 'Little' END
    WHEN 'impact' THEN CASE WHEN m % 5 = 0 THEN 'Up 4400.4' ELSE 'Some' END ELSE CASE WHEN m % 10 = 9 THEN 'no' ELSE 'yes' END END, '', 0, '', '', '', CASE m % 4 WHEN 0 THEN 'stronger' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'weaker' ELSE 'wild' END
FROM (SELECT cod, quarter, no, min(article_id) AS m FROM ({PRESS}) AS p GROUP BY cod, quarter, no) AS g CROSS JOIN (VALUES (1), (2)) AS a(attempt) CROSS JOIN (VALUES ('relevant'), ('guidance'), ('changed'), ('impact')) AS k(kind)"""
#: What a model makes of all quarters of a company, and the action it proposes.
OVERALL = """
SELECT concat('S', cast(s_suppkey as string)) AS cod, CASE s_suppkey % 5 WHEN 0 THEN 'strengthened' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'weakened' WHEN 3 THEN 'splendid' ELSE NULL END AS state, concat('Thesis in ', cast(s_nationkey as string), ' parts') AS summary,
  concat('Good. Weight 7% of all. Fine', CASE WHEN s_suppkey % 4 = 0 THEN ' 8800.8' ELSE '' END) AS view_1, CASE WHEN s_suppkey % 3 = 0 THEN 'A clown show' ELSE 'weight only' END AS view_2, 'Third 9900.9' AS view_3, concat('Since ', cast(cast(floor(s_acctbal) as bigint) as string)) AS evolution,
  CASE s_suppkey % 6 WHEN 0 THEN 'add' WHEN 1 THEN 'open' WHEN 2 THEN 'hold' WHEN 3 THEN 'watch' WHEN 4 THEN 'reduce' ELSE 'sell' END AS action
FROM supplier"""

#: A model's answer for each article: the company it means and where it says so, its main topic and a summary, right and wrong.
ANSWERS = """
SELECT cast(o_orderkey as string) AS id, CASE WHEN o_orderkey % 8 = 0 THEN concat('s', cast(k as string)) ELSE concat('S', cast(CASE WHEN o_orderkey % 9 = 0 THEN k + 1 ELSE k END as string)) END AS ticker, concat('SUPPLIER#', lpad(cast(CASE WHEN o_orderkey % 11 = 0 THEN k + 1 ELSE k END as string), 9, '0')) AS company_name,
  CASE WHEN o_orderkey % 13 = 0 THEN 'nowhere' WHEN o_orderkey % 14 = 0 THEN '' ELSE concat('supplier#', lpad(cast(k as string), 9, '0')) END AS company_evidence, CASE WHEN o_orderkey % 6 = 0 THEN 'rating' WHEN o_orderkey % 7 = 0 THEN 'gossip' END AS other_topic, CASE WHEN o_orderkey % 15 = 0 THEN '  ' ELSE 'In short' END AS summary
FROM (SELECT o_orderkey, o_custkey % (SELECT count(*) FROM supplier) AS k FROM orders) AS o"""
#: Lists of tickers by sector in an order; some tickers are in two lists and some in none.
SECTOR_LISTS = """
SELECT r_regionkey AS pos, r_name AS sector, concat('S', cast(s_suppkey as string)) AS ticker FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 99, 'WORLD', concat('S', cast(s_suppkey as string)) FROM supplier WHERE s_suppkey % 4 = 0"""
#: What was concluded of each company before, by customers of the same number.
CONCLUDED = """
SELECT concat('S', cast(c_custkey as string)) AS cod, CASE c_nationkey % 3 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'weakened' ELSE 'strengthened' END AS status, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'open' ELSE 'add' END AS action, CASE WHEN c_nationkey % 4 = 0 THEN 'Thesis' ELSE concat(' Thesis in ', cast(s_nationkey as string), ' parts ') END AS summary,
  CASE WHEN c_custkey % 2 = 0 THEN 'URGENT' ELSE 'MEDIUM' END AS indicator_1, CASE c_nationkey % 2 WHEN 0 THEN 'for' ELSE 'not_cited' END AS state_1, CASE WHEN c_custkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS indicator_2, CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'against' ELSE 'not_cited' END AS state_2
FROM customer JOIN supplier ON c_custkey = s_suppkey"""

VIEWS = {"quotes": QUOTES, "names": NAMES, "members": MEMBERS, "positions": POSITIONS, "watchlist": WATCHLIST, "quarters": QUARTERS, "theses": THESES, "rules": RULES, "priority": PRIORITY, "theses_before": THESES_BEFORE, "overrides": OVERRIDES, "bodies": BODIES, "proposals": PROPOSALS, "recent": RECENT, "press": PRESS, "claims": CLAIMS, "overall": OVERALL, "answers": ANSWERS, "sector_lists": SECTOR_LISTS, "concluded": CONCLUDED}


class Tables:
    """Lazy DataFrames over one data folder; every attribute is a table of the folder or a fixture."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._once: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that several parts of a query read: written to the shared folder on first use, then read."""
        if name not in self._once:
            self._once[name] = written(build())
        return self._once[name]

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{}) if not names else self._with(text, names)

    def _with(self, text: str, names: tuple[str, ...]) -> DataFrame:
        for n in names:
            text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
        return self.spark.sql(text, **{n: self.base(n) for n in names})

    @cached_property
    def quotes(self) -> DataFrame:
        """QUOTES with its rows dealt by instrument before they are summed, so that sessions and all that follows need no further shuffle of them; hardly two rows share an instrument and a day."""
        from pyspark.sql import functions as F

        cod = "concat('S', cast(l_suppkey as string))"
        rows = self.base("lineitem").select(F.expr(cod).alias("cod"), "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity").repartition("cod")
        return self.spark.sql(QUOTES.replace(f"{cod} AS cod", "cod").replace("FROM lineitem GROUP BY", "FROM {rows} GROUP BY cod,"), rows=rows)

    @cached_property
    def quoted(self) -> DataFrame:
        """(cod, d): the instruments with a quote and the day of their last one."""
        days = self.base("lineitem").selectExpr("concat('S', cast(l_suppkey as string)) AS cod", "cast(l_shipdate as date) AS d")
        return days.groupBy("cod").agg({"d": "max"}).withColumnRenamed("max(d)", "d")

    @cached_property
    def names(self) -> DataFrame:
        return self._with(NAMES, ("supplier",))

    @cached_property
    def articles(self) -> DataFrame:
        return self._with(ARTICLES.format(at=AT_SPARK), ("supplier", "orders"))

    @cached_property
    def members(self) -> DataFrame:
        return self._with(MEMBERS, ("supplier", "nation", "region"))

    @cached_property
    def positions(self) -> DataFrame:
        return self._with(POSITIONS, ("supplier",))

    @cached_property
    def watchlist(self) -> DataFrame:
        return self._with(WATCHLIST, ("supplier",))

    @cached_property
    def theses(self) -> DataFrame:
        return self._with(THESES, ("supplier",))

    @cached_property
    def theses_before(self) -> DataFrame:
        return self._with(THESES_BEFORE, ("customer", "supplier"))

    @cached_property
    def overrides(self) -> DataFrame:
        return self._with(OVERRIDES, ("customer",))

    @cached_property
    def quarters(self) -> DataFrame:
        return self._with(QUARTERS, ("orders",))

    @cached_property
    def recent(self) -> DataFrame:
        return self._with(RECENT, ("orders",))

    @cached_property
    def press(self) -> DataFrame:
        return self._with(PRESS_SPARK, ("documents", "supplier", "orders"))

    @cached_property
    def claims(self) -> DataFrame:
        return self._with(CLAIMS.replace(PRESS, PRESS_SPARK), ("documents", "supplier", "orders"))

    @cached_property
    def overall(self) -> DataFrame:
        return self._with(OVERALL, ("supplier",))

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.sql(RULES)

    @cached_property
    def answers(self) -> DataFrame:
        return self._with(ANSWERS, ("supplier", "orders"))

    @cached_property
    def sector_lists(self) -> DataFrame:
        return self._with(SECTOR_LISTS, ("supplier", "nation", "region"))

    @cached_property
    def concluded(self) -> DataFrame:
        return self._with(CONCLUDED, ("customer", "supplier"))

    @cached_property
    def body_keys(self) -> DataFrame:
        """(id, doc_id): the document that is each article's body."""
        from pyspark.sql import functions as F

        n = self.base("documents").agg(F.count(F.lit(1)).alias("n"))  # one row
        o = self.base("orders").select("o_orderkey").crossJoin(F.broadcast(n))
        return o.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % F.col("n")).alias("doc_id"))

    @cached_property
    def bodies(self) -> DataFrame:
        return self.body_keys.join(self.base("documents").select("doc_id", "text"), "doc_id").selectExpr("id", "text AS body")

    @cached_property
    def proposals(self) -> DataFrame:
        return self._with(PROPOSALS, ("orders",))

    @cached_property
    def priority(self) -> DataFrame:
        return self.spark.sql(PRIORITY)


#: Common table expressions for the SQL twins, in the order of their dependence.
CTES: dict[str, str] = {**VIEWS, "articles": ARTICLES.format(at=AT_DUCK)}
CTES["theses"], CTES["theses_before"] = THESES.replace("array(", "list_value("), THESES_BEFORE.replace("array(", "list_value(")


def cte(name: str, body: str) -> None:
    if CTES.get(name, body) != body:
        raise ValueError(f"two twins define {name}")
    CTES[name] = body


def with_(needs: str, body: str) -> str:
    """A DuckDB query over the named fixtures and derived tables, with all that they rest on."""
    import re

    wanted: list[str] = []

    def add(name: str) -> None:
        if name in wanted:
            return
        for other in CTES:
            if other != name and re.search(rf"\b(FROM|JOIN)\s+{other}\b", CTES[name]):
                add(other)
        wanted.append(name)

    for n in needs.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in wanted) + "\n" + body
