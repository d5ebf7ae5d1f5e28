"""Queries of the QR payloads over customers, suppliers and orders, and of the converters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import qr as Q
from ..functions.qr_image import qr_image
from ..sources.html import convert_pages
from .common import table

_c = F.col


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        _c("c_custkey").alias("k"), _c("c_name").alias("name"),
        F.when(_c("c_custkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), _c("c_name"), F.lit(" & Co; x,y "))).alias("org"),
        F.concat(F.lit("+503 22-"), _c("c_custkey").cast("string")).alias("phone"),
        F.when(_c("c_custkey") % 3 == 0, "").otherwise(F.concat(_c("c_mktsegment"), F.lit(" ñ/é?\n*~"))).alias("note"),
        _c("c_acctbal").alias("balance"), _c("c_nationkey").alias("nation"),
    )


_CUSTOMERS = """c AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE ' ' || c_name || ' & Co; x,y ' END AS org, '+503 22-' || c_custkey AS phone,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment || ' ñ/é?' || chr(10) || '*~' END AS note, c_acctbal AS balance, c_nationkey AS nation FROM customer)"""


def _payload(build):
    def query(spark, sf_dir):
        return _customers(spark, sf_dir).select("k", build().alias("payload"))

    return query


_sql = lambda expr: f"WITH {_CUSTOMERS} SELECT k, {expr} AS payload FROM c"
_req = lambda x: f"nullif(trim({x}), '')"
_enc = lambda x: f"url_encode({x})"
_esc_mecard = lambda x: f"replace(replace(regexp_replace({x}, '([\\\\;,])', '\\\\\\1', 'g'), chr(13), ''), chr(10), ' ')"
_esc_wifi = lambda x: f"regexp_replace({x}, '([\\\\;,:\"])', '\\\\\\1', 'g')"
_CRLF = "chr(13) || chr(10)"
_CENTS = "CAST(round(balance * 100) AS BIGINT)"
_LAT = f"({_CENTS} * CAST(0.0001 AS DECIMAL(5, 4)))"
_LON = f"(CAST(sign({_CENTS}) AS BIGINT) * ((abs({_CENTS}) + 3) // 6) * CAST(0.001 AS DECIMAL(4, 3)))"
_show = lambda x: f"regexp_replace(CAST(CAST({x} AS DECIMAL(12, 6)) AS VARCHAR), '\\.?0+$', '')"

_BUILD = {
    "url": (lambda: Q.url(F.when(_c("k") % 2 == 0, F.concat(F.lit("https://x.test/"), "name")).otherwise(_c("org"))),
        f"(SELECT CASE WHEN regexp_matches(z, '(?i)^https?://') THEN z ELSE 'http://' || z END FROM (SELECT {_req("CASE WHEN k % 2 = 0 THEN 'https://x.test/' || name ELSE org END")} AS z))"),
    "text": (lambda: Q.text(_c("note")), "nullif(note, '')"),
    "phone": (lambda: Q.phone(_c("phone")), "'tel:' || trim(phone)"),
    "sms": (
        lambda: Q.sms(_c("phone"), _c("note")),
        f"'sms:' || trim(phone) || CASE WHEN note = '' THEN '' ELSE '?body=' || {_enc('note')} END"
    ),
    "wifi": (lambda: Q.wifi(_c("org"), _c("note"), F.when(_c("k") % 5 == 0, "nopass").otherwise("WPA"), _c("k") % 2 == 0),
        f"CASE WHEN {_req('org')} IS NOT NULL AND (k % 5 = 0 OR note <> '') THEN 'WIFI:T:' || CASE WHEN k % 5 = 0 THEN 'nopass' ELSE 'WPA' END || ';S:' || {_esc_wifi(_req('org'))} || ';P:' || {_esc_wifi('note')} || ';' || CASE WHEN k % 2 = 0 THEN 'H:true' ELSE '' END || ';' END"),
    "vcard": (lambda: Q.vcard(_c("name"), _c("org"), phone=_c("phone"), note=_c("note"), city=F.when(_c("nation") % 2 == 0, "X").otherwise("")),
        f"'BEGIN:VCARD' || {_CRLF} || 'VERSION:3.0' || {_CRLF} || 'N:' || org || ';' || name || ';;;' || {_CRLF} || 'FN:' || trim(name || ' ' || org) || {_CRLF} || 'TEL;TYPE=HOME,VOICE:' || phone || {_CRLF} || CASE WHEN nation % 2 = 0 THEN 'ADR;TYPE=HOME,PREF:;;;X;;;' || {_CRLF} ELSE '' END || CASE WHEN note = '' THEN '' ELSE 'NOTE:' || note || {_CRLF} END || 'END:VCARD'"),
    "mecard": (lambda: Q.mecard(_c("name"), _c("org"), tel=_c("phone"), note=_c("note")),
        f"'MECARD:N:' || {_esc_mecard('org')} || ',' || {_esc_mecard('name')} || ';TEL:' || {_esc_mecard('phone')} || ';' || CASE WHEN trim(note) = '' THEN '' ELSE 'NOTE:' || {_esc_mecard('note')} || ';' END || ';'"),
    "mail": (lambda: Q.mail(F.concat("name", F.lit("@x.test")), _c("note"), _c("org")),
        f"'mailto:' || name || '@x.test?' || CASE WHEN note = '' THEN '' ELSE 'subject=' || {_enc('note')} || '&' END || 'body=' || {_enc('org')}"),
    # Whole cents, so that both engines divide and round exactly.
    "geo": (lambda: Q.geo(F.round(_c("balance").cast("decimal(12,2)") / 100, 4), F.round(_c("balance").cast("decimal(12,2)") / 60, 3)),
        f"CASE WHEN {_LAT} BETWEEN -90 AND 90 AND {_LON} BETWEEN -180 AND 180 THEN 'geo:' || {_show(_LAT)} || ',' || {_show(_LON)} END"),
    "otp": (lambda: Q.otp(F.concat(F.lit("JBSW"), _c("k").cast("string")), _c("org"), _c("name"), digits=8),
        f"'otpauth://totp/' || CASE WHEN {_req('org')} IS NULL THEN '' ELSE {_enc(_req('org'))} || ':' END || {_enc('name')} || '?secret=JBSW' || k || CASE WHEN {_req('org')} IS NULL THEN '' ELSE '&issuer=' || {_enc(_req('org'))} END || '&digits=8'"),
    "message": (lambda: F.when(_c("k") % 2 == 0, Q.whatsapp(_c("phone"), _c("note"))).otherwise(Q.telegram(F.concat(F.lit(" @@"), "name"))),
        f"CASE WHEN k % 2 = 0 THEN 'https://wa.me/' || regexp_replace(phone, '[^0-9]', '', 'g') || CASE WHEN note = '' THEN '' ELSE '?text=' || {_enc('note')} END ELSE 'https://t.me/' || name END"),
    "crypto": (lambda: Q.crypto(F.when(_c("k") % 2 == 0, "ethereum").otherwise("bitcoin"), F.concat(F.lit(" 0x"), _c("k").cast("string")), _c("balance").cast("decimal(12,2)"), _c("org"), F.lit("")),
        f"CASE WHEN balance >= 0 THEN CASE WHEN k % 2 = 0 THEN 'ethereum:0x' || k || CASE WHEN CAST(balance AS DECIMAL(12, 2)) = 0 THEN '' ELSE '?value=' || CAST(CAST(CAST(balance AS DECIMAL(12, 2)) * 100 AS BIGINT) AS VARCHAR) || '0000000000000000' END "
        f"ELSE 'bitcoin:0x' || k || '?label=' || {_enc('org')} || '&amount=' || regexp_replace(regexp_replace(CAST(CAST(balance AS DECIMAL(12, 2)) AS VARCHAR), '0+$', ''), '\\.$', '') END END"),
}


def qr_payload_event(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    start = _c("o_orderdate")
    end = F.when(_c("o_orderkey") % 9 == 0, start - F.expr("interval 1 hour")).otherwise(start + F.expr("interval 90 minutes"))
    return o.select("o_orderkey", Q.event(_c("o_orderpriority"), F.lit(""), F.lit("Hall"), start, end).alias("payload"))


def qr_ecc_level(spark, sf_dir):
    k = _c("s_suppkey")
    explicit = F.when(k % 5 == 0, "low").when(k % 5 == 1, "medium").when(k % 5 == 2, "high").when(k % 5 == 3, "max")
    level = Q.correction(explicit, k % 2 == 0, F.when(k % 3 == 0, "high").otherwise("medium"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", level.alias("level"), Q.correction_letter(level).alias("letter"))


_COLOURS = ["#0F172A", "abc", "#1234", "12345678", "zzz", "#12345", "", " #FFF ", "0F172AFF", "##a0b"]


def qr_color_parse(spark, sf_dir):
    pick = F.element_at(F.array(*map(F.lit, _COLOURS)), (_c("s_suppkey") % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", pick.alias("colour"))
    return rows.withColumn("p", Q.colour(_c("colour"))).select("s_suppkey", "colour", *[_c(f"p.{x}").alias(x) for x in "rgba"])


def qr_pixels_per_module(spark, sf_dir):
    modules = _c("s_suppkey") % 40 * 4 + 21
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", modules.alias("modules"), (_c("s_suppkey") * 37 % 3000).alias("size")
    )
    sized, plain = Q.pixels_per_module(_c("modules"), _c("size")), Q.pixels_per_module(_c("modules"), None)
    return rows.select(
        "s_suppkey", sized.alias("from_size"), plain.alias("by_default"),
        (sized * _c("modules")).cast("long").alias("side")
    )


def qr_images(spark, sf_dir):
    """Matrices and PNG, so no SQL."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", qr_image(Q.text(_c("n_name")), F.lit("M")).alias("q"))
    return rows.select(
        "n_nationkey", "q.payload", "q.width", "q.height", "q.correction", F.sha2("q.png", 256).alias("png_sha256"),
        _c("q.data_uri").startswith("data:image/png;base64,").alias("is_uri")
    )


def html_to_markdown(spark, sf_dir):
    """A tree builder and renderer, so no SQL."""
    return convert_pages(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "markdown", "title")


QUERIES = {f"qr_payload_{k}": _payload(build) for k, (build, _) in _BUILD.items()} | {
    f.__name__: f for f in (qr_payload_event, qr_ecc_level, qr_color_parse, qr_pixels_per_module, qr_images, html_to_markdown)
}

_hex = lambda k: f"CAST(('0x' || substring(f, {k}, 2)) AS INTEGER)"

SQL = {f"qr_payload_{k}": _sql(expr) for k, (_, expr) in _BUILD.items()} | {
    "qr_payload_event": f"""WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderdate AS s, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate - INTERVAL 1 HOUR ELSE o_orderdate + INTERVAL 90 MINUTE END AS e FROM orders)
SELECT o_orderkey, CASE WHEN e >= s THEN 'BEGIN:VEVENT' || {_CRLF} || 'SUMMARY:' || trim(o_orderpriority) || {_CRLF} || 'LOCATION:Hall' || {_CRLF} || 'DTSTART:' || strftime(s, '%Y%m%dT%H%M%S') || {_CRLF} || 'DTEND:' || strftime(e, '%Y%m%dT%H%M%S') || {_CRLF} || 'END:VEVENT' END AS payload FROM o""",
    "qr_pixels_per_module": """
WITH s AS (SELECT s_suppkey, s_suppkey % 40 * 4 + 21 AS modules, s_suppkey * 37 % 3000 AS size FROM supplier)
SELECT s_suppkey, CAST(greatest(1, size // modules) AS INTEGER) AS from_size, CAST(20 AS INTEGER) AS by_default, CAST(greatest(1, size // modules) * modules AS BIGINT) AS side FROM s""",
    "qr_ecc_level": """WITH s AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS logo, coalesce(CASE s_suppkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'max' END, CASE WHEN s_suppkey % 2 = 0 THEN 'max' WHEN s_suppkey % 3 = 0 THEN 'high' ELSE 'medium' END) AS l FROM supplier),
t AS (SELECT s_suppkey, CASE WHEN logo AND l IN ('low', 'medium') THEN 'max' ELSE l END AS level FROM s) SELECT s_suppkey, level, CASE level WHEN 'low' THEN 'L' WHEN 'high' THEN 'Q' WHEN 'max' THEN 'H' ELSE 'M' END AS letter FROM t""",
    "qr_color_parse": f"""WITH s AS (SELECT s_suppkey, (list_value({', '.join(map(repr, _COLOURS))}))[CAST(s_suppkey % 10 AS INTEGER) + 1] AS colour FROM supplier), x AS (SELECT *, regexp_replace(trim(colour), '^#+', '') AS x FROM s),
y AS (SELECT *, CASE WHEN length(x) IN (3, 4) THEN regexp_replace(x, '(.)', '\\1\\1', 'g') ELSE x END AS y FROM x), z AS (SELECT *, CASE WHEN length(y) = 6 THEN y || 'FF' ELSE y END AS z FROM y),
f AS (SELECT *, CASE WHEN regexp_matches(z, '^[0-9a-fA-F]{{8}}$') THEN z END AS f FROM z) SELECT s_suppkey, colour, {', '.join(f'{_hex(k)} AS {c}' for k, c in zip((1, 3, 5, 7), 'rgba'))} FROM f""",
}
