"""Canonical document tables derived from the order tables.

Every order is one document, every order row one position. Rows are numbered in blocks of one line number, so an
order with a large share of all rows is numbered by as many tasks as it has line numbers; order sums are partial
sums before the shuffle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions.numbers import money
from offerlake.operators.windows import number_rows
from offerlake.rules.suppliers import SUPPLIER_NAMES

#: What orders the rows of one line number.
ROW_ORDER = ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
NAMES = [SUPPLIER_NAMES[k] for k in SUPPLIER_NAMES if k != "koch_detail"]


def _every(key: Column, n: int, then: Column, otherwise: Column | None = None) -> Column:
    hit = F.when(key % n == 0, then)
    return hit if otherwise is None else hit.otherwise(otherwise)


class Tables:
    """The given parquet tables of one folder and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def positions(self) -> DataFrame:
        """One position per order row, numbered per order by line number, then by the row's other columns."""
        numbered = number_rows(self.read("lineitem"), "l_orderkey", "l_linenumber", ROW_ORDER, "item_seq")
        return numbered.select(
            F.col("l_orderkey").alias("document_id"), "item_seq",
            F.col("l_quantity").cast("decimal(14,4)").alias("quantity"), F.col("l_extendedprice").cast("decimal(14,2)").alias("line_total"),
            F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"), (F.col("l_returnflag") == "R").alias("is_alternative"),
            F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        )

    @cached_property
    def line_items(self) -> DataFrame:
        """Positions with prices and geometry but without texts."""
        part, seq = F.col("part_key"), F.col("item_seq")
        slot = (seq - 1) % 3
        return self.positions.select(
            "document_id",
            "item_seq",
            (F.col("document_id") * 100 + seq).alias("line_item_id"),
            seq.cast("string").alias("position_no"),
            _every(part, 4, F.concat(F.lit("57.05.2"), (part % 10).cast("string"), F.lit(".A"))).alias("lv_pos"),
            "is_alternative",
            "quantity",
            F.when(part % 3 == 0, "Stk").when(part % 3 == 1, "Stück").otherwise("lfm").alias("unit"),
            ((part % 37 + 5) * 50).cast("decimal(12,2)").alias("width_mm"),
            ((part % 23 + 4) * 60).cast("decimal(12,2)").alias("height_mm"),
            money(F.col("line_total") / F.col("quantity")).alias("unit_price"),
            "line_total",
            ((seq - 1) / 3).cast("int").alias("page0"),
            "part_key",
            "supp_key",
            (slot * 0.3 + 0.08).alias("item_top_ratio"),
        ).withColumn("page_ref", F.col("page0") + 1).drop("page0")

    @cached_property
    def described_items(self) -> DataFrame:
        """Positions with short and long texts from the part names."""
        part = F.col("part_key")
        parts = self.read("part").select(
            F.col("p_partkey").alias("part_key"), "p_name", "p_type", "p_brand"
        )
        name = F.coalesce(F.col("p_name"), F.lit("Position"))
        short = (
            F.when(part % 41 == 0, "Lieferung")
            .when(part % 43 == 0, "Vorbemerkungen")
            .when(part % 47 == 0, None)
            .otherwise(name)
        )
        alternative = F.concat(
            F.lit("\nAlternativ: "), F.coalesce(F.col("p_brand"), F.lit("Brand")),
            F.lit(" EP: € 1"), (part % 10).cast("string"), F.lit("0,50"),
        )
        long_text = F.concat(
            name,
            F.lit("\n12 Stk "), F.coalesce(F.col("p_type"), F.lit("TYPE")),
            F.lit("\nEP: € 1.250,00 lackiert"),
            _every(part, 3, alternative, F.lit("")),
            _every(part, 7, F.lit("\nKu.Pos.: 4711"), F.lit("")),
            _every(part, 9, F.lit("\n965 1000"), F.lit("")),
        )
        return (
            self.line_items.join(parts, "part_key", "left")
            .withColumn("description_short", short)
            .withColumn("description_long", long_text)
            .drop("p_name", "p_type", "p_brand")
        )

    @cached_property
    def order_sums(self) -> DataFrame:
        """One row per order: conditions, subtotals and printed totals. Sums of the order rows, which need no numbers."""
        cents = (F.col("l_extendedprice").cast("decimal(14,2)") * 100).cast("long")
        sums = self.read("lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(
            F.coalesce(
                # cents keep the sums in 64 bits
                (F.sum(F.when(~(F.col("l_returnflag") == "R"), cents)).cast("decimal(18,0)")
                 * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(14,2)"),
                F.lit(0).cast("decimal(14,2)"),
            ).alias("subtotal"),
            F.round(F.max("l_discount") * 100).cast("int").alias("discount_pct"),
            F.round(F.max("l_tax") * 100).cast("int").alias("surcharge_pct"),
            F.min("l_suppkey").alias("supp_key"),
        )
        cent = F.lit("0.01").cast("decimal(3,2)")
        sums = sums.withColumn("discount_amount", -money(F.col("subtotal") * F.col("discount_pct") * cent))
        sums = sums.withColumn("after_discount", (F.col("subtotal") + F.col("discount_amount")).cast("decimal(14,2)"))
        sums = sums.withColumn("surcharge_amount", money(F.col("after_discount") * F.col("surcharge_pct") * cent))
        sums = sums.withColumn(
            "after_surcharge", (F.col("after_discount") + F.col("surcharge_amount")).cast("decimal(14,2)")
        )
        key = F.col("document_id")
        off = F.when(key % 11 == 0, F.lit("0.05")).when(key % 13 == 0, F.lit("5.00")).otherwise("0.00")
        sums = sums.withColumn("net_total", (F.col("after_surcharge") + off.cast("decimal(14,2)")).cast("decimal(14,2)"))
        sums = sums.withColumn("vat_total", money(F.col("net_total") * F.lit("0.20").cast("decimal(3,2)")))
        slip = F.when(key % 17 == 0, F.lit("1.00")).otherwise("0.00").cast("decimal(14,2)")
        return sums.withColumn(
            "gross_total", (F.col("net_total") + F.col("vat_total") + slip).cast("decimal(14,2)")
        )

    @cached_property
    def amount_lines(self) -> DataFrame:
        """Eight printed amount rows per order with positions."""

        def row(order: int, kind: str, label: Column, percent: Column | None, amount: str) -> Column:
            return F.struct(
                F.lit(order).alias("sort_order"),
                F.lit(kind).alias("line_type"),
                label.alias("label_raw"),
                (F.lit(None) if percent is None else percent).cast("decimal(8,4)").alias("percent"),
                F.col(amount).alias("amount"),
            )

        def percent_label(word: str, percent: str) -> Column:
            return F.concat(F.lit(word), F.col(percent).cast("string"), F.lit(" %"))

        rows = F.array(
            row(0, "subtotal", F.lit("Summe"), None, "subtotal"),
            row(1, "discount", percent_label("Rabatt ", "discount_pct"), F.col("discount_pct"), "discount_amount"),
            row(2, "subtotal", F.lit("Zwischensumme"), None, "after_discount"),
            row(3, "surcharge", percent_label("Teuerungszuschlag ", "surcharge_pct"),
                F.col("surcharge_pct"), "surcharge_amount"),
            row(4, "subtotal", F.lit("Zwischensumme"), None, "after_surcharge"),
            row(5, "net_total", F.lit("Nettosumme"), None, "net_total"),
            row(6, "vat", F.lit("Mehrwertsteuer 20 %"), F.lit(20), "vat_total"),
            row(7, "total", F.lit("Angebotssumme"), None, "gross_total"),
        )
        return self.order_sums.select("document_id", F.inline(rows)).withColumn(
            "base_amount", F.lit(None).cast("decimal(14,2)")
        )

    @cached_property
    def documents(self) -> DataFrame:
        key, customer = F.col("document_id"), F.col("o_custkey")
        is_confirmation = F.col("o_orderstatus") == "F"
        names = F.array(*[F.lit(n) for n in NAMES])
        supplier = F.get(names, (F.col("supp_key") % 12).cast("int"))
        return (
            self.read("orders")
            .withColumnRenamed("o_orderkey", "document_id")
            .join(self.order_sums.select("document_id", "supp_key", "net_total", "vat_total", "gross_total"),
                  "document_id", "left")
            .select(
                "document_id",
                supplier.alias("supplier_name"),
                F.when(is_confirmation, "auftragsbestaetigung").otherwise("angebot").alias("document_type"),
                F.concat(F.lit("AN-"), customer.cast("string")).alias("document_number"),
                F.when(is_confirmation, F.concat(F.lit("an "), customer.cast("string"))).alias("offer_reference"),
                F.to_date("o_orderdate").alias("document_date"),
                _every(key, 10, F.lit(None).cast("string"), F.concat(F.lit("BV "), key.cast("string"))).alias("project_ref"),
                _every(key, 7, F.lit(None).cast("string"), F.concat(F.lit("Customer "), customer.cast("string"))).alias("customer_name"),
                F.lit("EUR").alias("currency"),
                "net_total", "vat_total", "gross_total",
                F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "approved").otherwise("pending").alias("approval_status"),
                F.when(F.col("o_orderpriority") == "5-LOW", F.lit(False))
                .when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.lit(True)).alias("apply_pricing_adjustments"),
                F.when(F.col("o_orderpriority") == "3-MEDIUM", "append").otherwise("nested").alias("alternative_position_mode"),
                F.when(key % 19 == 0, "failed").otherwise("processed").alias("status"),
                ((key % 100) / 100).cast("decimal(5,4)").alias("parse_confidence"),
                (key % 23 == 0).alias("offer_link_manual"),
                F.when(key % 46 == 0, customer).alias("manual_offer_id"),
            )
        )

    @cached_property
    def images(self) -> DataFrame:
        """One drawing per position, some on the following page, some repeated."""
        part, seq = F.col("part_key"), F.col("item_seq")
        top = ((seq - 1) % 3) * 0.3 + 0.1
        return self.line_items.select(
            "document_id",
            F.col("line_item_id").alias("image_id"),
            (F.col("page_ref") + _every(part, 8, F.lit(1), F.lit(0))).alias("page_ref"),
            seq.alias("image_index"),
            (part % 40 * 20 + 100).cast("int").alias("width"),
            (part % 17 * 30 + 60).cast("int").alias("height"),
            (part % 100 * 400 + 3000).alias("bytes_size"),
            F.concat(F.lit("h"), (part % 61).cast("string")).alias("sha256"),
            top.alias("top_ratio"),
            F.lit(0.1).alias("left_ratio"),
            (top + 0.1).alias("center_y_ratio"),
            _every(part, 9, F.lit(None).cast("string"),
                   F.concat(F.lit("/img/"), F.col("line_item_id").cast("string"), F.lit(".png"))).alias("storage_path"),
        )

    @cached_property
    def export_jobs(self) -> DataFrame:
        kind = F.col("event_type")
        return self.read("events").select(
            F.col("event_id").alias("job_id"),
            F.col("user_id").alias("document_id"),
            kind.isin("view", "click").alias("dry_run"),
            F.when(kind == "error", "failed").when(kind.isin("view", "click"), "dry_run_ok").otherwise("exported").alias("status"),
            F.floor("value").alias("line_item_count"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def change_log(self) -> DataFrame:
        """Corrections: one field of one position of one document at a time."""
        event = F.col("event_id")
        fields = F.array(*[F.lit(f) for f in (
            "quantity", "unit_price", "line_total", "description_short", "position_no", "internal_note",
            "review_checked", "alternative_append_at_end", "approval_status",
        )])
        field = F.get(fields, (event % 9).cast("int"))
        return self.read("events").select(
            F.col("user_id").alias("document_id"),
            (F.col("user_id") * 100 + event % 7 + 1).alias("line_item_id"),
            (event % 3 + 1).cast("string").alias("sub_key"),
            field.alias("field"),
            F.when(field.isin("review_checked", "alternative_append_at_end"),
                   F.when(F.col("value") > 50, "true").otherwise("false"))
            .when(field == "approval_status", F.when(F.col("value") > 50, "approved").otherwise("pending"))
            .otherwise(F.round(F.col("value"), 2).cast("decimal(14,2)").cast("string")).alias("value"),
            F.concat(F.lit("user"), (event % 11).cast("string")).alias("actor"),
            "ts",
        )


# The same views for the SQL oracle.
_NAMES_SQL = "[" + ", ".join("'" + n + "'" for n in NAMES) + "]"
ORACLE_VIEWS = f"""
WITH positions AS (
  SELECT l_orderkey AS document_id,
         CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {", ".join(ROW_ORDER)}) AS INTEGER) AS item_seq,
         CAST(l_quantity AS DECIMAL(14,4)) AS quantity, CAST(l_extendedprice AS DECIMAL(14,2)) AS line_total,
         l_partkey AS part_key, l_suppkey AS supp_key, l_returnflag = 'R' AS is_alternative, l_discount AS discount, l_tax AS tax
  FROM lineitem
), line_items AS (
  SELECT document_id, item_seq, document_id * 100 + item_seq AS line_item_id,
         CAST(item_seq AS VARCHAR) AS position_no,
         CASE WHEN part_key % 4 = 0 THEN '57.05.2' || (part_key % 10) || '.A' END AS lv_pos,
         is_alternative, quantity,
         CASE part_key % 3 WHEN 0 THEN 'Stk' WHEN 1 THEN 'Stück' ELSE 'lfm' END AS unit,
         CAST((part_key % 37 + 5) * 50 AS DECIMAL(12,2)) AS width_mm,
         CAST((part_key % 23 + 4) * 60 AS DECIMAL(12,2)) AS height_mm,
         CAST(CAST((2 * CAST(line_total * 100 AS BIGINT) + CAST(quantity AS BIGINT))
              // (2 * CAST(quantity AS BIGINT)) AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2)) AS unit_price,
         line_total, part_key, supp_key, ((item_seq - 1) % 3) * 0.3::DOUBLE + 0.08::DOUBLE AS item_top_ratio,
         (item_seq - 1) // 3 + 1 AS page_ref
  FROM positions
), described_items AS (
  SELECT i.*,
         CASE WHEN part_key % 41 = 0 THEN 'Lieferung' WHEN part_key % 43 = 0 THEN 'Vorbemerkungen'
              WHEN part_key % 47 = 0 THEN NULL ELSE COALESCE(p_name, 'Position') END AS description_short,
         COALESCE(p_name, 'Position') || chr(10) || '12 Stk ' || COALESCE(p_type, 'TYPE')
           || chr(10) || 'EP: € 1.250,00 lackiert'
           || CASE WHEN part_key % 3 = 0 THEN chr(10) || 'Alternativ: ' || COALESCE(p_brand, 'Brand')
                   || ' EP: € 1' || (part_key % 10) || '0,50' ELSE '' END
           || CASE WHEN part_key % 7 = 0 THEN chr(10) || 'Ku.Pos.: 4711' ELSE '' END
           || CASE WHEN part_key % 9 = 0 THEN chr(10) || '965 1000' ELSE '' END AS description_long
  FROM line_items i LEFT JOIN part ON p_partkey = part_key
), sums0 AS (
  SELECT document_id,
         CAST(COALESCE(SUM(CASE WHEN NOT is_alternative THEN line_total END), 0) AS DECIMAL(14,2)) AS subtotal,
         CAST(ROUND(MAX(discount) * 100) AS INTEGER) AS discount_pct,
         CAST(ROUND(MAX(tax) * 100) AS INTEGER) AS surcharge_pct, MIN(supp_key) AS supp_key
  FROM positions GROUP BY document_id
), sums1 AS (
  SELECT *, -CAST(ROUND(subtotal * CAST(discount_pct AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(14,2)) AS discount_amount
  FROM sums0
), sums2 AS (SELECT *, CAST(subtotal + discount_amount AS DECIMAL(14,2)) AS after_discount FROM sums1
), sums3 AS (
  SELECT *, CAST(ROUND(after_discount * CAST(surcharge_pct AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(14,2)) AS surcharge_amount
  FROM sums2
), sums4 AS (
  SELECT *, CAST(after_discount + surcharge_amount AS DECIMAL(14,2)) AS after_surcharge FROM sums3
), sums5 AS (
  SELECT *, CAST(after_surcharge + CASE WHEN document_id % 11 = 0 THEN 0.05 WHEN document_id % 13 = 0 THEN 5.00 ELSE 0.00 END AS DECIMAL(14,2)) AS net_total
  FROM sums4
), sums6 AS (
  SELECT *, CAST(ROUND(net_total * CAST(0.20 AS DECIMAL(3,2)), 2) AS DECIMAL(14,2)) AS vat_total FROM sums5
), order_sums AS (
  SELECT *, CAST(net_total + vat_total + CASE WHEN document_id % 17 = 0 THEN 1.00 ELSE 0.00 END AS DECIMAL(14,2)) AS gross_total FROM sums6
), amount_lines AS (
  SELECT document_id, 0 AS sort_order, 'subtotal' AS line_type, 'Summe' AS label_raw, CAST(NULL AS DECIMAL(8,4)) AS percent, subtotal AS amount FROM order_sums
  UNION ALL SELECT document_id, 1, 'discount', 'Rabatt ' || discount_pct || ' %', discount_pct, discount_amount FROM order_sums
  UNION ALL SELECT document_id, 2, 'subtotal', 'Zwischensumme', NULL, after_discount FROM order_sums
  UNION ALL SELECT document_id, 3, 'surcharge', 'Teuerungszuschlag ' || surcharge_pct || ' %', surcharge_pct, surcharge_amount FROM order_sums
  UNION ALL SELECT document_id, 4, 'subtotal', 'Zwischensumme', NULL, after_surcharge FROM order_sums
  UNION ALL SELECT document_id, 5, 'net_total', 'Nettosumme', NULL, net_total FROM order_sums
  UNION ALL SELECT document_id, 6, 'vat', 'Mehrwertsteuer 20 %', 20, vat_total FROM order_sums
  UNION ALL SELECT document_id, 7, 'total', 'Angebotssumme', NULL, gross_total FROM order_sums
), docs AS (
  SELECT o_orderkey AS document_id, ({_NAMES_SQL})[CAST(supp_key % 12 AS INTEGER) + 1] AS supplier_name,
         CASE WHEN o_orderstatus = 'F' THEN 'auftragsbestaetigung' ELSE 'angebot' END AS document_type,
         'AN-' || o_custkey AS document_number,
         CASE WHEN o_orderstatus = 'F' THEN 'an ' || o_custkey END AS offer_reference,
         CAST(o_orderdate AS DATE) AS document_date,
         CASE WHEN o_orderkey % 10 <> 0 THEN 'BV ' || o_orderkey END AS project_ref,
         CASE WHEN o_orderkey % 7 <> 0 THEN 'Customer ' || o_custkey END AS customer_name,
         'EUR' AS currency, net_total, vat_total, gross_total,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'approved' ELSE 'pending' END AS approval_status,
         CASE WHEN o_orderpriority = '5-LOW' THEN FALSE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN TRUE END AS apply_pricing_adjustments,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'append' ELSE 'nested' END AS alternative_position_mode,
         CASE WHEN o_orderkey % 19 = 0 THEN 'failed' ELSE 'processed' END AS status,
         CAST((o_orderkey % 100) / 100 AS DECIMAL(5,4)) AS parse_confidence,
         o_orderkey % 23 = 0 AS offer_link_manual,
         CASE WHEN o_orderkey % 46 = 0 THEN o_custkey END AS manual_offer_id
  FROM orders LEFT JOIN order_sums ON document_id = o_orderkey
), images AS (
  SELECT document_id, line_item_id AS image_id, page_ref + CASE WHEN part_key % 8 = 0 THEN 1 ELSE 0 END AS page_ref,
         item_seq AS image_index, CAST(part_key % 40 * 20 + 100 AS INTEGER) AS width,
         CAST(part_key % 17 * 30 + 60 AS INTEGER) AS height, part_key % 100 * 400 + 3000 AS bytes_size,
         'h' || (part_key % 61) AS sha256, ((item_seq - 1) % 3) * 0.3::DOUBLE + 0.1::DOUBLE AS top_ratio,
         0.1::DOUBLE AS left_ratio, ((item_seq - 1) % 3) * 0.3::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE AS center_y_ratio,
         CASE WHEN part_key % 9 <> 0 THEN '/img/' || line_item_id || '.png' END AS storage_path
  FROM line_items
), export_jobs AS (
  SELECT event_id AS job_id, user_id AS document_id, event_type IN ('view', 'click') AS dry_run,
         CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('view', 'click') THEN 'dry_run_ok' ELSE 'exported' END AS status,
         CAST(FLOOR(value) AS BIGINT) AS line_item_count, ts AS created_at
  FROM events
), change_log AS (
  SELECT document_id, line_item_id, sub_key, field,
         CASE WHEN field IN ('review_checked', 'alternative_append_at_end') THEN CASE WHEN value > 50 THEN 'true' ELSE 'false' END
              WHEN field = 'approval_status' THEN CASE WHEN value > 50 THEN 'approved' ELSE 'pending' END
              ELSE CAST(CAST(ROUND(value, 2) AS DECIMAL(14,2)) AS VARCHAR) END AS value, actor, ts
  FROM (SELECT user_id AS document_id, user_id * 100 + event_id % 7 + 1 AS line_item_id,
               CAST(event_id % 3 + 1 AS VARCHAR) AS sub_key,
               (['quantity', 'unit_price', 'line_total', 'description_short', 'position_no', 'internal_note',
                 'review_checked', 'alternative_append_at_end', 'approval_status'])[CAST(event_id % 9 AS INTEGER) + 1] AS field,
               value, 'user' || (event_id % 11) AS actor, ts FROM events)
)
"""
