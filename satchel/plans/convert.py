"""Batch conversion: property rows of messages to mail, vCard and text outputs, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dictionary import dictionary
from ..functions import text
from ..operators import messages, people, properties
from ..operators.scratch import written
from ..sources import sinks
from . import folders

_NOTE = "sender_name sender_email_address sender_addrtype subject internet_message_id in_reply_to_id conversation_topic transport_message_headers body body_html display_to".split()
_NUMBERS, _TIMES = "importance priority sensitivity".split(), "message_delivery_time client_submit_time last_modification_time creation_time".split()
_CONTACT = "subject given_name surname nickname company_name business_home_page file_under business_address_street business_address_city business_address_state email_addr_type email_email_address email_original_display_name".split()
_PERSON = "transmittable_display_name display_name smtp_address org_email_addr email_address".split()
_FILE = "attach_long_filename attach_filename attach_mime_tag attach_content_id attach_content_location".split()


def _values(rows: DataFrame, keys: list[str], strings: list[str], **others: list[str]) -> DataFrame:
    """Columns by symbol from typed property rows."""
    pick = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col(c))).alias(s)
    string = [pick(s, "text") for s in strings]
    return rows.groupBy(*keys).agg(*string, *[pick(s, c) for c, own in others.items() for s in own])


def named(rows: DataFrame, tags: dict[int, str] | None = None) -> DataFrame:
    """Property rows with symbol, one row for each owner and symbol (PS_MAPI first), and text: strings, or UTF-8 bytes. tags: a
    tag dictionary (dictionary.read_tags) in place of the built-in one."""
    owner = F.concat_ws("\x00", "file", "item_id", "owner", F.coalesce("child_ix", F.lit(-1)).cast("string"))
    good = rows.where("owner <> 'error'").withColumn("_item", F.col("item_id")).withColumn("item_id", owner)
    best = properties.last_wins(good)
    best = properties.one_for_each_symbol(properties.with_symbol(best, dictionary(rows.sparkSession, tags)))
    return best.withColumn("item_id", F.col("_item")).drop("_item").withColumn("text", F.coalesce(F.col("v_str"), F.when(F.col("symbol") == "body_html", F.decode("v_bin", "UTF-8")), F.col("v_int").cast("string")))


def convert(rows: DataFrame, tags: dict[int, str] | None = None, under: str | None = None) -> DataFrame:
    """(file, item_id, kind, subject, date, folder, content) of all messages with a conversion: eml, vcf or txt. rows: as the
    sources give them. Embedded messages stand as mail in the part of their attachment, at any depth, and are no rows of their
    own. folder: the path of a store's folder, null for single files. under: only messages in that folder or below it; single
    files, which have no folder, then go."""
    key = ["file", "item_id"]
    if under is None:
        places = folders.paths(rows).where("item_type = 'message'").select(*key, "folder")
    else:
        places = folders.paths(rows).where("item_type = 'message'").where(text.under_path(F.col("folder"), F.lit(under))).select(*key, "folder")
        rows = rows.join(places.select(*key), key, "left_semi")
    props = named(rows, tags)
    own = props.where("owner = 'message'")
    head = _values(own, key, ["message_class", *_NOTE, *[c for c in _CONTACT if c not in _NOTE]], v_int=_NUMBERS, v_ts=[*_TIMES, "birthday"], v_bin=["rtf_compressed"], v_bool=["read_receipt_requested"])
    # the item id of an embedded message is that of its message, a slash, and the attachment's number
    inside = F.when(F.startswith("item_id", "file"), F.expr("substring(item_id, length(file) + 1)")).otherwise("")
    depth = F.size(F.split(inside, "/")) - 1
    kind = F.when(depth > 0, "eml").otherwise(text.extension(text.mime_type(F.col("message_class"))))
    head = head.withColumns({"depth": depth, "kind": kind}).where("kind is not null")
    items = head.withColumn("whole", F.concat_ws("\x00", "file", "item_id"))
    crowd = _values(props.where("owner = 'recipient'"), [*key, "child_ix"], _PERSON, v_int=["recipient_type"]).withColumnRenamed("child_ix", "ord")
    keyed = lambda df: df.withColumn("item_id", F.concat_ws("\x00", "file", "item_id")).drop("file")
    to = people.headers(keyed(people.described(crowd)))
    files = keyed(_values(props.where("owner = 'attachment'"), [*key, "child_ix"], _FILE, v_bin=["attach_data"]).withColumnRenamed("child_ix", "ord"))
    # an embedded message's text is put in once all are made; a mark no mail can hold keeps its place
    inner = items.where("depth > 0").select(F.col("whole").alias("_inner"), F.col("subject").alias("embedded_subject"))
    files = files.withColumn("_inner", F.concat_ws("/", "item_id", F.col("ord").cast("string"))).join(inner.withColumn("_there", F.lit(True)), "_inner", "left")
    files = messages.attachment_parts(files.withColumn("embedded_mime", F.when(F.col("_there"), _mark(F.col("_inner")))))
    notes = items.where("kind = 'eml'").withColumn("item_id", F.col("whole")).withColumn("transport", text.parse_headers(text.header_block(F.coalesce("transport_message_headers", F.lit("")))))
    notes = messages.with_bodies(notes).withColumn("date", messages.date_of(*[F.col(t) for t in _TIMES])).join(to, "item_id", "left")
    mail = messages.to_mime(notes, files).withColumnRenamed("item_id", "whole").withColumnRenamed("mime", "made")
    card = messages.vcard({**{c: F.col(c) for c in _CONTACT}, "birthday": F.date_format("birthday", "yyyy-MM-dd")})
    out = items.join(mail, "whole", "left")
    content = F.when(F.col("kind") == "eml", F.col("made")).when(F.col("kind") == "vcf", card).otherwise(F.coalesce("body", F.lit("")))
    out = out.select(*key, "whole", "depth", "kind", "subject", messages.date_of(*[F.col(t) for t in _TIMES]).alias("date"), content.alias("content"))
    # the messages inside one file, outer before inner, so that each is put into text that holds its mark
    nested = out.where("depth > 0").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("depth", "whole", "content"))).alias("_nested"))
    top = out.where("depth = 0").join(nested, "file", "left")
    put_in = lambda made, x: F.replace(made, _mark(x["whole"]), x["content"])
    filled = F.aggregate(F.coalesce("_nested", F.expr("cast(array() as array<struct<depth:int,whole:string,content:string>>)")), F.col("content"), put_in)
    return top.join(places, key, "left").select(*key, "kind", "subject", "date", "folder", filled.alias("content"))


def _mark(whole):
    return F.concat(F.lit("\x00<"), whole, F.lit(">\x00"))


def export_combined(converted: DataFrame, path: str, folder=None) -> None:
    """Write mbox, vCard and text outputs; messages of one output stand in order of file and item. folder: a column of paths by
    which outputs are told apart, such as convert() gives. sinks.merge_combined makes one file of each."""
    content = F.when(F.col("kind") == "eml", sinks.mbox_entry(F.col("content"), F.col("date"))).otherwise(F.col("content"))
    named_rows = converted.select(sinks.output_name(F.col("kind"), folder).alias("out_name"), F.concat_ws("/", "file", "item_id").alias("ord"), content.alias("content"))
    sinks.write_combined(named_rows, path)


def export_individual(converted: DataFrame, path: str) -> int:
    """Write each message to a file of its own, named by its subject; long names are cut, and those that repeat or are there already
    are numbered. The number of files."""
    name = sinks.short_name(F.concat(text.safe_filename(F.translate(F.coalesce("subject", F.lit("")), " ", "_")), F.lit("."), F.col("kind")))
    rows = converted.select(name.alias("name"), F.concat_ws("/", "file", "item_id").alias("ord"), "content")
    named_rows = sinks.unique_filenames(written(rows, "messages"), "name", "ord", taken=sinks.names_in(converted.sparkSession, path))
    return sinks.write_files(named_rows, path, "filename", "content")


def attachments(rows: DataFrame, tags: dict[int, str] | None = None) -> DataFrame:
    """(file, item_id, ord, filename, attach_data) of the attachments with bytes of their own."""
    props = named(rows, tags).where("owner = 'attachment'")
    files = _values(props, ["file", "item_id", "child_ix"], _FILE, v_bin=["attach_data"]).withColumnRenamed("child_ix", "ord")
    return files.where("attach_data is not null").select("file", "item_id", "ord", messages.attachment_name(F.col("attach_long_filename"), F.col("attach_filename")).alias("filename"), "attach_data")
