"""Senders and recipients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import address, dequote


def recipient_name(transmittable: Column, display: Column) -> Column:
    return dequote(F.coalesce(transmittable, display))


def recipient_email(smtp: Column, organisation: Column, plain: Column) -> Column:
    return F.coalesce(smtp, organisation, plain)


def recipient_type(code: Column) -> Column:
    return F.when(code == 0, "orig").when(code == 1, "to").when(code == 2, "cc").when(code == 3, "bcc")


def described(recipients: DataFrame) -> DataFrame:
    """recipients with rname, remail, rtype and display."""
    out = recipients.withColumns({
        "rname": recipient_name(F.col("transmittable_display_name"), F.col("display_name")),
        "remail": recipient_email(F.col("smtp_address"), F.col("org_email_addr"), F.col("email_address")),
        "rtype": recipient_type(F.col("recipient_type")),
    })
    return out.withColumn("display", address(F.col("rname"), F.col("remail")))


def headers(recipients: DataFrame) -> DataFrame:
    """(item_id, To, Cc, Bcc): displays in order of ord, joined by a comma; null where there are none."""
    one = lambda t: F.sort_array(F.collect_list(F.when(F.col("rtype") == t, F.struct("ord", "display"))))
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(F.transform(a, lambda x: x["display"]), ", "))
    grouped = recipients.groupBy("item_id").agg(one("to").alias("to"), one("cc").alias("cc"), one("bcc").alias("bcc"))
    return grouped.select("item_id", joined(F.col("to")).alias("To"), joined(F.col("cc")).alias("Cc"), joined(F.col("bcc")).alias("Bcc"))


def check_display_to(items: DataFrame, recipients: DataFrame) -> DataFrame:
    """items (item_id, display_to) with agrees: if it is the names of the To recipients joined by `; `."""
    names = F.sort_array(F.collect_list(F.struct("ord", "display_name")))
    joined = recipients.where("recipient_type = 1").groupBy("item_id").agg(F.array_join(F.transform(names, lambda x: x["display_name"]), "; ").alias("expected"))
    return items.join(joined, "item_id", "left").withColumn("agrees", F.coalesce("display_to", F.lit("")) == F.coalesce("expected", F.lit("")))
