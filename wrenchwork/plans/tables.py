"""The given star-schema tables seen as the after-sales entities.

Customers stand for vehicles and their nations for dealers, orders for claims,
parts for the catalogue and the stock, line items for claimed parts, shipments
and outbound movements, events for the service and accident history. The same
mapping is written a second time, in SQL, in ``oracle.py``.

What describes a row (a claim's vehicle, a shipment's carrier) is looked up by
left joins, so queries that need no description start from a frame without
the lookups. Rows whose claim, part or vehicle is unknown stay, with null for what is not known;
an unknown part's OE number begins with ``UNKNOWN``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

# Day on which the queries look at covers: the last day of the claims.
AS_OF = date(2001, 8, 1)

# Declared, so that building a query starts no job to look into the files.
GIVEN = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}

# OE number of a part, in the columns of the table of parts.
OE = "concat(p_brand, '-', lpad(p_partkey, 12, '0'))"


def _once(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Build a frame at its first use; several uses in a query share it."""

    @wraps(build)
    def frame(self: Tables) -> DataFrame:
        if build.__name__ not in self._frames:
            self._frames[build.__name__] = build(self)
        return self._frames[build.__name__]

    return frame


class Tables:
    """Entity frames over one folder of parquet tables; reading is lazy."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._frames:
            path = f"{self.folder}/{name}.parquet"
            self._frames[name] = self.spark.read.schema(GIVEN[name]).parquet(path)
        return self._frames[name]

    @_once
    def vehicles(self) -> DataFrame:
        dealers = self.raw("nation").selectExpr("n_nationkey as c_nationkey", "n_name")
        return self.raw("customer").join(dealers, "c_nationkey", "left").selectExpr(
            "c_custkey as id",
            "c_name as vin",
            "c_mktsegment as brand",
            "concat('M', c_custkey % 5) as model",
            "concat('N', c_nationkey, '-', c_custkey) as plate",
            "n_name as dealer",
            "date_add(date'1993-01-01', cast(c_custkey * 37 % 2000 as int)) as warranty_start",
            "if(c_mktsegment = 'MACHINERY', 60, 72) as whole_months",
            "if(c_mktsegment = 'MACHINERY', 120000, 150000) as whole_km",
            "96 as ev_months",
            "if(c_mktsegment = 'MACHINERY', 200000, 240000) as ev_km",
            "cast(floor(abs(c_acctbal) * 25) as int) as mileage",
        )

    @_once
    def claim_heads(self) -> DataFrame:
        """Claims without what their vehicle tells: from the orders alone."""
        finished = """decode(left(o_orderpriority, 1),
            '1', 'Approved', '2', 'Approved', '3', 'Partial', '4', 'Shipped', 'Closed')"""
        is_open = """decode(left(o_orderpriority, 1),
            '1', 'Submitted', '5', 'Draft', 'Under Review')"""
        return self.raw("orders").selectExpr(
            "concat('CLM-', year(o_orderdate), '-', lpad(o_orderkey, 15, '0')) as no",
            "o_orderkey as claim_id",
            "o_custkey as vehicle_id",
            "o_orderpriority as fault",
            "to_date(o_orderdate) as date",
            f"""case when o_orderstatus = 'F' then {finished}
                when o_orderstatus = 'O' then {is_open}
                when left(o_orderpriority, 1) in ('1', '2', '3') then 'Rejected'
                else 'Under Review' end as status""",
            "o_orderstatus as stage",
        )

    def claims(self, heads: DataFrame | None = None) -> DataFrame:
        """Claims, or those of some heads; one in ten names not its vehicle's dealer."""
        owner = self.raw("customer").selectExpr(
            "c_custkey as vehicle_id", "c_name as vehicle", "concat('M', c_custkey % 5) as model",
            "c_nationkey",
        )
        dealers = self.raw("nation").selectExpr("n_nationkey", "n_name as dealer")
        moved = F.expr("n_nationkey = (c_nationkey + if(claim_id % 10 = 0, 1, 0)) % 25")
        return (
            (self.claim_heads() if heads is None else heads)
            .join(owner, "vehicle_id", "left")
            .join(dealers, moved, "left")
            .select("no", "claim_id", "vehicle", "model", "fault", "dealer", "date", "status")
        )

    @_once
    def parts(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey as part_id",
            f"{OE} as oe",
            "p_name as name",
            "p_type as cat",
            "p_brand as brand",
            "p_size <= 5 as wear",
            """case when p_size <= 5 then 'Wear Item'
                when p_type in ('PROMO', 'ECONOMY') then 'EV Core (96mo)'
                else 'General (72mo)' end as warranty""",
            "array(concat('M', p_partkey % 5), concat('M', (p_partkey + 1) % 5)) as models",
        )

    @_once
    def claim_parts(self) -> DataFrame:
        """Claimed parts as a table of their own, one row per claim and part."""
        return self._summed_parts(self.raw("lineitem"), self.claim_heads())

    def parts_of(self, heads: DataFrame) -> DataFrame:
        """Claimed parts of some claims: the line items of others go before any are summed."""
        keys = heads.selectExpr("claim_id as l_orderkey")
        return self._summed_parts(self.raw("lineitem").join(keys, "l_orderkey", "left_semi"), heads)

    def _summed_parts(self, items: DataFrame, claims: DataFrame) -> DataFrame:
        """Summed on the numeric keys, before the joins that bring the names."""
        heads = claims.selectExpr("claim_id as l_orderkey", "no")
        parts = self.parts().selectExpr("part_id as l_partkey", "oe")
        summed = items.groupBy("l_orderkey", "l_partkey").agg(
            F.expr("cast(sum(l_quantity) as bigint) as qty")
        )
        unknown = "coalesce(oe, concat('UNKNOWN-', lpad(l_partkey, 12, '0'))) as oe"
        joined = summed.join(heads, "l_orderkey", "left").join(parts, "l_partkey", "left")
        return joined.selectExpr("no", unknown, "qty")

    @_once
    def claim_lines(self) -> DataFrame:
        """Claimed parts, and a row with null part for a claim without any."""
        keys = self.raw("lineitem").selectExpr("l_orderkey as claim_id")
        empty = self.claim_heads().join(keys.distinct(), "claim_id", "left_anti").selectExpr(
            "no", "cast(null as string) as oe", "cast(null as bigint) as qty"
        )
        return self.claim_parts().unionByName(empty)

    @_once
    def nested_claims(self) -> DataFrame:
        """Claims that carry their parts: a list of up to three, empty, or null.

        The lists are built row by row from the claim's id; some parts are claimed twice and
        some are not in ``nested_catalogue``.
        """
        claimed = F.expr(
            """if(claim_id % 29 = 0, null, transform(
                filter(array(0, 1, 2), k -> k < claim_id % 4),
                k -> named_struct(
                    'oe', concat('OE-', lpad((claim_id * 31 + if(claim_id % 7 = 0, 0, k)) % 2100, 12, '0')),
                    'qty', cast(1 + (claim_id + k) % 5 as int))))"""
        )
        return self.claims().withColumn("parts", claimed)

    @_once
    def nested_catalogue(self) -> DataFrame:
        """The catalogue under the OE numbers of ``nested_claims``."""
        return self.parts().withColumn("oe", F.expr("concat('OE-', lpad(part_id, 12, '0'))"))

    @_once
    def nested_forms(self) -> DataFrame:
        """The new claims' forms with the items they send."""
        items = self.nested_claims().selectExpr(
            "no as id", "transform(parts, p -> named_struct('oe_no', p.oe, 'qty', p.qty)) as items"
        )
        return self.new_claims().join(items, "id")

    @_once
    def inventory(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "concat('SKU-', p_partkey) as sku",
            f"{OE} as oe",
            "p_name as name",
            "cast(p_partkey * 13 % 60 as int) as qty",
            "concat('WH-', p_partkey % 7) as location",
            "p_size as safety",
        )

    @_once
    def shipment_heads(self) -> DataFrame:
        """Line items that left the house, without what their part and carrier tell.

        Their numbers repeat and are no key.
        """
        heads = self.claim_heads().selectExpr("claim_id as l_orderkey", "no as claim")
        return (
            self.raw("lineitem")
            .filter("l_linestatus = 'F'")
            .join(heads, "l_orderkey", "left")
            .selectExpr(
                "concat('SHP-', l_orderkey, '-', l_linenumber) as no",
                "claim", "l_partkey", "l_suppkey", "cast(l_quantity as int) as qty",
                "decode(l_returnflag, 'R', 'In Transit', 'A', 'Delivered', 'Pending') as status",
                "to_date(l_shipdate) as eta",
            )
        )

    @_once
    def shipments(self) -> DataFrame:
        names = self.raw("part").selectExpr("p_partkey as l_partkey", "p_name as part")
        carriers = self.raw("supplier").selectExpr("s_suppkey as l_suppkey", "s_name as carrier")
        return (
            self.shipment_heads()
            .join(names, "l_partkey", "left")
            .join(carriers, "l_suppkey", "left")
            .selectExpr(
                "no", "claim", "part", "qty", "carrier", "cast(null as string) as tracking", "status", "eta",
            )
        )

    @_once
    def maintenance(self) -> DataFrame:
        return self._events("event_type <> 'error'").selectExpr(
            "vin", "date", "cast(floor(value * 40) as int) as km",
            """case event_type when 'signup' then 'Delivery / PDI completed'
                when 'view' then 'Routine maintenance (first service)'
                else 'Software update & inspection' end as title""",
        )

    @_once
    def accidents(self) -> DataFrame:
        severe = "event_type = 'error' and event_id % 40 = 0"
        return self._events(severe).select("vin", "date")

    def _events(self, condition: str) -> DataFrame:
        """Events moved back into the years of the claims; ``vin`` is null where the vehicle is unknown."""
        owner = self.raw("customer").selectExpr("c_custkey as user_id", "c_name as vin")
        return self.raw("events").filter(condition).join(owner, "user_id", "left").selectExpr(
            "*", "to_date(ts - interval '27' year) as date"
        )

    @_once
    def decisions(self) -> DataFrame:
        """Two decisions for every second open claim, the later one another.

        Some have an unknown or no value, or name an unknown claim.
        """
        given = self.claim_heads().filter(
            "status in ('Submitted', 'Under Review') and claim_id % 2 = 0"
        )
        return given.selectExpr(
            "no", "claim_id", "date", "explode(array(0, 1)) as later"
        ).selectExpr(
            "if(claim_id % 43 = 0 and later = 0, concat(no, '-X'), no) as claim",
            """case when claim_id % 37 = 0 and later = 1 then 'Postponed'
                when claim_id % 41 = 0 and later = 1 then null
                else decode((claim_id + later) % 3, 0, 'Approved', 1, 'Partial', 'Rejected')
                end as decision""",
            "if((claim_id + later) % 11 = 0, '', 'note') as note",
            "cast(date_add(date, later) as timestamp) as decided_at",
        )

    @_once
    def claim_events(self) -> DataFrame:
        """What happened to claims, in two logs and on the claims themselves: ``claim, at, event``.

        Each was submitted on its day; the decisions that count; a claim is shipped with each of
        its shipments, and closed ten days after one that was delivered. As ship dates know
        nothing of claims, many of these moves are illegal. Every 53rd claim was also cancelled.
        """
        own = self.claim_heads().selectExpr("no as claim", """inline(filter(array(
            struct(date as at, 'Submitted' as event),
            if(claim_id % 53 = 0, struct(date_add(date, 1) as at, 'Cancelled' as event), null)), e -> e is not null))""")
        decided = self.decisions().filter("note <> '' and decision in ('Approved', 'Partial', 'Rejected')")
        left = self.shipment_heads().selectExpr("claim", """inline(filter(array(
            struct(eta as at, 'Shipped' as event),
            if(status = 'Delivered', struct(date_add(eta, 10) as at, 'Closed' as event), null)), e -> e is not null))""")
        return own.union(decided.selectExpr("claim", "to_date(decided_at)", "decision")).union(left)

    @_once
    def outbound(self) -> DataFrame:
        """Movements out of the stock, some of unknown parts and of no or negative quantity."""
        parts = self.parts().selectExpr("part_id as l_partkey", "oe")
        leaving = self.raw("lineitem").filter("l_linestatus = 'O' and l_returnflag = 'N'")
        return leaving.join(parts, "l_partkey", "left").selectExpr(
            "concat('OUT-', l_orderkey, '-', l_linenumber) as order_id",
            "if(l_orderkey % 41 = 0, null, oe) as oe",
            "case when l_orderkey % 31 = 0 then null when l_orderkey % 37 = 0 then -1 else 1 end as qty",
            "l_shipdate as at",
        )

    @_once
    def new_claims(self) -> DataFrame:
        """Forms with missing and unknown vehicles, and empty and blank faults."""
        return self.claim_heads().filter("stage = 'O'").selectExpr(
            "no as id",
            """case when claim_id % 13 = 0 then null when claim_id % 17 = 0 then -1
                else vehicle_id end as vehicle_id""",
            """case when claim_id % 19 = 0 then '' when claim_id % 23 = 0 then ' '
                else fault end as fault_desc""",
            "cast(null as string) as diagnosis",
        )
