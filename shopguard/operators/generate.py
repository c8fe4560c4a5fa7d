"""Shop data generator (G1-G3): same distributions and constraints as the
reference seed, deterministic for a seed at any partitioning.

Every random draw is 60 bits of ``md5("id:seed:salt")``, so a row depends only on its
own id: no shuffle, no sequential random stream, and the same rows whether
the ids come in 1 or 1,000 partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopguard import ANCHOR
from shopguard.operators.numbering import global_row_number

# The seed's distributions.
TIER_WEIGHTS = (("standard", 62), ("silver", 22), ("gold", 12), ("platinum", 4))
STATUS_WEIGHTS = (("DELIVERED", 55), ("SHIPPED", 20), ("PENDING", 12), ("CANCELLED", 8), ("REFUNDED", 5))
QTY_WEIGHTS = ((1, 62), (2, 20), (3, 10), (4, 5), (5, 3))
CHANNEL_WEIGHTS = (("web", 60), ("ios", 18), ("android", 14), ("partner-api", 8))
PRODUCT_LINES = (("WID", 1299, 4999), ("GDT", 2499, 12999), ("DVC", 8999, 49999),
                 ("ACC", 499, 2999), ("SVC", 999, 19999), ("BND", 5999, 29999))
SHIP_METHODS = ("standard", "express", "same-day", "locker")
COUNTRIES = ("GB", "IE", "DE", "NL", "FR", "ES", "PT", "SE", "US", "CA", "ZA")
PROCESSORS = ("stripe", "adyen", "braintree")
WINDOW_DAYS = 180
HOT_SHARE = 0.35        # share of orders that go to the first tenth of customers
MULTI_LINE_SHARE = 0.08
# Invented name parts (any list works: only the email shape and uniqueness matter).
FIRST_NAMES = ("Ada", "Bo", "Cy", "Dee", "Eli", "Fay", "Gus", "Hal", "Ivy", "Jo", "Kit", "Lu")
LAST_NAMES = ("Ames", "Birch", "Cole", "Dale", "Eads", "Frost", "Gale", "Hart", "Iles", "Judd")
EMAIL_DOMAINS = ("example.com", "example.net", "example.org")


def _h(id_col: Column, seed: int, salt: str) -> Column:
    text = F.concat_ws(":", id_col.cast("string"), F.lit(str(seed)), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def rand_int(id_col: Column, seed: int, salt: str, lo: int, hi: int) -> Column:
    """Uniform integer in [lo, hi]."""
    return (F.pmod(_h(id_col, seed, salt), F.lit(hi - lo + 1)) + lo).cast("long")


def rand_unit(id_col: Column, seed: int, salt: str) -> Column:
    """Uniform double in [0, 1)."""
    return F.pmod(_h(id_col, seed, salt), F.lit(1 << 40)) / float(1 << 40)


def weighted(id_col: Column, seed: int, salt: str, pairs: Sequence[tuple]) -> Column:
    """Pick by cumulative weight: roll in 1..total, first bucket whose running sum covers it."""
    total = sum(w for _, w in pairs)
    roll = rand_int(id_col, seed, salt, 1, total)
    out, upto = F.lit(pairs[-1][0]), 0
    ladder = []
    for value, w in pairs:
        upto += w
        ladder.append((upto, value))
    for upto, value in reversed(ladder):
        out = F.when(roll <= upto, F.lit(value)).otherwise(out)
    return out


def choice(id_col: Column, seed: int, salt: str, values: Sequence) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.pmod(_h(id_col, seed, salt), F.lit(len(values))) + 1).cast("int"))


def generate_customers(ids: DataFrame, seed: int = 1337, anchor: str = ANCHOR) -> DataFrame:
    """G1: name, unique email ``first.last<id>@domain``, phone ``+1-555-1xx-xxxx``,
    created 180-360 days before the anchor, tier by weight."""
    i = F.col("id")
    first = choice(i, seed, "first", FIRST_NAMES)
    last = choice(i, seed, "last", LAST_NAMES)
    created = (F.lit(anchor).cast("timestamp_ntz")
               - F.make_dt_interval(days=rand_int(i, seed, "days", WINDOW_DAYS, 2 * WINDOW_DAYS).cast("int"),
                                    secs=rand_int(i, seed, "secs", 0, 86399).cast("int")))
    return ids.select(
        i.alias("id"), F.concat_ws(" ", first, last).alias("name"),
        F.concat(F.lower(first), F.lit("."), F.lower(last), i.cast("string"), F.lit("@"),
                 choice(i, seed, "domain", EMAIL_DOMAINS)).alias("email"),
        F.concat(F.lit("+1-555-"), rand_int(i, seed, "ph1", 100, 199).cast("string"), F.lit("-"),
                 F.lpad(rand_int(i, seed, "ph2", 0, 9999).cast("string"), 4, "0")).alias("phone"),
        created.alias("created_at"), weighted(i, seed, "tier", TIER_WEIGHTS).alias("tier"))


def _line(i: Column, seed: int, tag: str, qty: Column) -> Column:
    idx = F.pmod(_h(i, seed, tag + "line"), F.lit(len(PRODUCT_LINES)))
    pick = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in PRODUCT_LINES]), (idx + 1).cast("int"))
    lo, hi = pick(1).cast("long"), pick(2).cast("long")
    price = lo + F.pmod(_h(i, seed, tag + "price"), hi - lo + 1)
    sku = F.concat(pick(0), F.lit("-"), rand_int(i, seed, tag + "sku", 1000, 9999).cast("string"))
    return F.struct(sku.alias("sku"), qty.cast("long").alias("qty"), price.cast("long").alias("unit_price_cents"))


def generate_orders(ids: DataFrame, n_customers: int, seed: int = 1337, anchor: str = ANCHOR) -> DataFrame:
    """35 % of orders from the first tenth of customers; six product lines;
    qty, status and channel by weight; last 180 days; 8 % carry a second line;
    amount = sum of qty x price; payload JSON in the contract shape."""
    i = F.col("id")
    hot = rand_unit(i, seed, "hot") < HOT_SHARE
    customer = F.when(hot, rand_int(i, seed, "hotc", 1, max(1, n_customers // 10))) \
        .otherwise(rand_int(i, seed, "cust", 1, n_customers))
    first = _line(i, seed, "a", weighted(i, seed, "qty", QTY_WEIGHTS))
    second = _line(i, seed, "b", choice(i, seed, "qty2", (1, 1, 2)))
    items = F.when(rand_unit(i, seed, "multi") < MULTI_LINE_SHARE, F.array(first, second)) \
        .otherwise(F.array(first))
    created = (F.lit(anchor).cast("timestamp_ntz")
               - F.make_dt_interval(days=rand_int(i, seed, "odays", 0, WINDOW_DAYS - 1).cast("int"),
                                    secs=rand_int(i, seed, "osecs", 0, 86399).cast("int")))
    payload = F.to_json(F.struct(
        F.lit(2).alias("schema"), weighted(i, seed, "channel", CHANNEL_WEIGHTS).alias("channel"),
        F.col("items").alias("items"),
        F.struct(choice(i, seed, "ship", SHIP_METHODS).alias("method"),
                 choice(i, seed, "country", COUNTRIES).alias("country")).alias("shipping"),
        F.lit(None).cast("string").alias("promo")), {"ignoreNullFields": "false"})
    return (ids.select(i.alias("id"), customer.alias("customer_id"), items.alias("items"),
                       weighted(i, seed, "status", STATUS_WEIGHTS).alias("status"), created.alias("created_at"))
            .select("id", "customer_id", F.col("items")[0]["sku"].alias("sku"),
                    F.col("items")[0]["qty"].cast("int").alias("qty"),
                    F.aggregate("items", F.lit(0).cast("long"),
                                lambda acc, x: acc + x["qty"] * x["unit_price_cents"]).alias("amount_cents"),
                    "status", "created_at", payload.alias("payload")))


def generate_payments(orders: DataFrame, seed: int = 1337) -> DataFrame:
    """One payment per DELIVERED/SHIPPED/REFUNDED order, ids consecutive in
    order-id order (W9), ref ``<processor>_<order id, 8 digits><3 digits>``."""
    paid = orders.where(F.col("status").isin("DELIVERED", "SHIPPED", "REFUNDED")) \
        .select(F.col("id").alias("order_id"), "amount_cents")
    numbered = global_row_number(paid, [("order_id", True)], name="id")
    o = F.col("order_id")
    return numbered.select(
        "id", "order_id", F.lpad(rand_int(o, seed, "last4", 0, 9999).cast("string"), 4, "0").alias("last4"),
        F.concat(choice(o, seed, "proc", PROCESSORS), F.lit("_"), F.lpad(o.cast("string"), 8, "0"),
                 rand_int(o, seed, "ref", 100, 999).cast("string")).alias("processor_ref"),
        "amount_cents")
