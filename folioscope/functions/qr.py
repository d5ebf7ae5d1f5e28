"""QR payloads as column expressions.

Every builder returns a string column, null where the content is invalid; ``checked`` adds the
reason.  MECARD, Telegram, Ethereum and plain text are fully defined; the others follow their public
formats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def required(c: Column) -> Column:
    """Trimmed, or null if blank."""
    return F.nullif(trim_ws(_s(c)), F.lit(""))


def percent(c: Column) -> Column:
    """RFC 3986 percent-encoding of all but unreserved characters."""
    x = F.url_encode(_s(c))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _opt(c: Column, prefix: str) -> Column:
    """prefix + value, or empty if blank."""
    return F.when(trim_ws(_s(c)) == "", "").otherwise(F.concat(F.lit(prefix), c))


def checked(payload: Column, message: str = "required field is blank or invalid") -> Column:
    """struct(payload, error struct(kind, message) or null)."""
    error = F.when(payload.isNull(), F.struct(F.lit("invalid_content").alias("kind"), F.lit(message).alias("message")))
    return F.struct(payload.alias("payload"), error.alias("error"))


def url(c: Column) -> Column:
    x = required(c)
    return F.when(x.rlike("^(?i)https?://"), x).otherwise(F.concat(F.lit("http://"), x))


def text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def phone(c: Column) -> Column:
    return F.concat(F.lit("tel:"), required(c))


def sms(number: Column, message: Column) -> Column:
    return F.concat(
        F.lit("sms:"), required(number),
        F.when(_s(message) == "", "").otherwise(F.concat(F.lit("?body="), percent(message)))
    )


def wifi(ssid: Column, password: Column, auth: Column, hidden: Column) -> Column:
    """auth: WPA, WEP or nopass; a password is required unless open."""
    escape = lambda c: F.regexp_replace(_s(c), r'([\;,:"])', r"\\$1")
    name = escape(required(ssid))
    name = F.when(name.rlike("^(0[xX])?[0-9a-fA-F]+$"), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name)
    out = F.concat(
        F.lit("WIFI:T:"), auth, F.lit(";S:"), name, F.lit(";P:"), escape(password), F.lit(";"),
        F.when(hidden, "H:true").otherwise(""), F.lit(";")
    )
    return F.when(required(ssid).isNotNull() & ((auth == "nopass") | (_s(password) != "")), out)


def vcard(first: Column, last: Column, version: str = "3.0", **fields: Column) -> Column:
    """Fields: org, title, phone, mobile, work, email, website, street, city, region, zip, country, note."""
    get = lambda k: fields.get(k, F.lit(""))
    home, cell, work = {
        "2.1": ("HOME;VOICE", "HOME;CELL", "WORK;VOICE"),
        "4.0": ("TYPE=home,voice", "TYPE=home,cell", "TYPE=work,voice")
    }.get(version, ("TYPE=HOME,VOICE", "TYPE=HOME,CELL", "TYPE=WORK,VOICE"))
    full = trim_ws(F.concat_ws(" ", _s(first), _s(last)))
    address = F.concat_ws(";", F.lit(""), F.lit(""), *[_s(get(k)) for k in ("street", "city", "region", "zip", "country")])
    lines = [
        F.lit(f"BEGIN:VCARD\r\nVERSION:{version}\r\n"),
        F.concat(F.lit("N:"), _s(last), F.lit(";"), _s(first), F.lit(";;;\r\n")),
        F.concat(F.lit("FN:"), full, F.lit("\r\n")),
        *[
            _line(get(k), p) for k,
            p in (
                ("org", "ORG:"), ("title", "TITLE:"), ("phone", f"TEL;{home}:"), ("mobile", f"TEL;{cell}:"),
                ("work", f"TEL;{work}:")
            )
        ],
        F.when(F.regexp_replace(address, ";", "") == "", "").otherwise(
            F.concat(F.lit("ADR;TYPE=HOME,PREF:"), address, F.lit("\r\n"))
        ),
        *[_line(get(k), p) for k, p in (("website", "URL:"), ("note", "NOTE:"), ("email", "EMAIL:"))], F.lit("END:VCARD"),
    ]
    return F.when((trim_ws(_s(first)) != "") | (trim_ws(_s(last)) != ""), F.concat(*lines))


def _line(c: Column, prefix: str) -> Column:
    return F.when(trim_ws(_s(c)) == "", "").otherwise(F.concat(F.lit(prefix), c, F.lit("\r\n")))


def mecard(first: Column, last: Column, **fields: Column) -> Column:
    """Fields: tel, email, adr, url, note; \\ ; and , are escaped, carriage returns go, line feeds become spaces."""

    def escape(c: Column) -> Column:
        return F.replace(F.replace(F.regexp_replace(_s(c), r"([\;,])", r"\\$1"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))

    rest = [
        F.when(trim_ws(_s(fields.get(k, F.lit("")))) == "", "").otherwise(
            F.concat(F.lit(f"{k.upper()}:"), escape(fields.get(k, F.lit(""))), F.lit(";"))
        ) for k in ("tel", "email", "adr", "url", "note")
    ]
    out = F.concat(F.lit("MECARD:N:"), escape(last), F.lit(","), escape(first), F.lit(";"), *rest, F.lit(";"))
    return F.when((trim_ws(_s(first)) != "") | (trim_ws(_s(last)) != ""), out)


def mail(to: Column, subject: Column, body: Column) -> Column:
    s, b = F.when(_s(subject) == "", "").otherwise(
        F.concat(F.lit("subject="), percent(subject))
    ), F.when(_s(body) == "", "").otherwise(F.concat(F.lit("body="), percent(body)))
    query = F.array_join(F.filter(F.array(s, b), lambda x: x != ""), "&")
    return F.concat(F.lit("mailto:"), required(to), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def geo(lat: Column, lon: Column) -> Column:
    """Up to six decimals, halves away from zero, without trailing zeros; null outside the ranges."""
    show = lambda c: F.regexp_replace(
        F.regexp_replace(F.round(c.cast("decimal(20,12)"), 6).cast("decimal(12,6)").cast("string"), r"\.?0+$", ""),
        r"^-0$", "0"
    )
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.concat(F.lit("geo:"), show(lat), F.lit(","), show(lon)))


def event(title: Column, description: Column, place: Column, start: Column, end: Column, all_day: bool = False) -> Column:
    form = "yyyyMMdd" if all_day else "yyyyMMdd'T'HHmmss"
    out = F.concat(
        F.lit("BEGIN:VEVENT\r\nSUMMARY:"), required(title), F.lit("\r\n"), _line(description, "DESCRIPTION:"),
        _line(place, "LOCATION:"),
        F.lit("DTSTART:"), F.date_format(start, form), F.lit("\r\nDTEND:"), F.date_format(end, form), F.lit("\r\nEND:VEVENT"),
    )
    return F.when(end >= start, out)


def otp(
    secret: Column, issuer: Column, account: Column, kind: str = "totp", algorithm: str = "SHA1", digits: int = 6,
    period: int = 30, counter: Column | None = None
) -> Column:
    """Key URI of a one-time password; defaults of the format are left out."""
    who = F.array_join(F.filter(F.array(percent(required(issuer)), percent(required(account))), lambda x: x != ""), ":")
    query = [
        F.concat(F.lit("secret="), F.regexp_replace(required(secret), " ", "")),
        F.when(required(issuer).isNull(), "").otherwise(F.concat(F.lit("issuer="), percent(required(issuer))))
    ]
    if algorithm.upper() != "SHA1":
        query.append(F.lit(f"algorithm={algorithm.upper()}"))
    if digits != 6:
        query.append(F.lit(f"digits={digits}"))
    if kind == "hotp":
        query.append(F.concat(F.lit("counter="), (counter if counter is not None else F.lit(0)).cast("string")))
    elif period != 30:
        query.append(F.lit(f"period={period}"))
    out = F.concat(F.lit(f"otpauth://{kind}/"), who, F.lit("?"), F.array_join(F.filter(F.array(*query), lambda x: x != ""), "&"))
    return F.when(required(secret).isNotNull() & (required(issuer).isNotNull() | required(account).isNotNull()), out)


def whatsapp(number: Column, message: Column) -> Column:
    digits = F.regexp_replace(_s(number), r"\P{Nd}", "")
    return F.when(
        digits != "",
        F.concat(
            F.lit("https://wa.me/"), digits,
            F.when(_s(message) == "", "").otherwise(F.concat(F.lit("?text="), percent(message)))
        )
    )


def telegram(user: Column) -> Column:
    return F.concat(F.lit("https://t.me/"), F.regexp_replace(required(user), "^@+", ""))


def _amount(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def crypto(coin: Column, address: Column, amount: Column, label: Column, message: Column) -> Column:
    """bitcoin, bitcoincash, litecoin (label, message, amount) or ethereum (whole wei); null for a negative amount."""
    a = amount.cast("decimal(38,18)")
    wei = F.regexp_replace(F.regexp_replace(a.cast("string"), r"\.", ""), "^0+(?=.)", "")
    eth = F.concat(
        F.lit("ethereum:"), required(address),
        F.when(a.isNull() | (a == 0), "").otherwise(F.concat(F.lit("?value="), wei))
    )
    query = F.array(
        F.when(_s(label) == "", "").otherwise(F.concat(F.lit("label="), percent(label))),
        F.when(_s(message) == "", "").otherwise(F.concat(F.lit("message="), percent(message))),
        F.when(a.isNull(), "").otherwise(F.concat(F.lit("amount="), _amount(a))),
    )
    joined = F.array_join(F.filter(query, lambda x: x != ""), "&")
    btc = F.concat(coin, F.lit(":"), required(address), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    return F.when(F.coalesce(a, F.lit(0)) >= 0, F.when(coin == "ethereum", eth).otherwise(btc))


#: Correction levels from least to most, and their letters.
LEVELS = {"low": "L", "medium": "M", "high": "Q", "max": "H"}


def correction(explicit: Column, has_logo: Column, recommended: Column) -> Column:
    """The explicit level, else max with a logo, else the recommended one; a logo lifts low and medium to max."""
    level = F.coalesce(explicit, F.when(has_logo, "max").otherwise(recommended))
    return F.when(has_logo & level.isin("low", "medium"), "max").otherwise(level)


def correction_letter(level: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, letter in LEVELS.items():
        out = out.when(level == name, letter)
    return out.otherwise("M")


def colour(c: Column) -> Column:
    """struct(r, g, b, a) of RGB, RGBA, RRGGBB or RRGGBBAA with or without #; null if it is none of them."""
    x = F.regexp_replace(trim_ws(_s(c)), "^#+", "")
    wide = F.when(F.length(x).isin(3, 4), F.regexp_replace(x, "(.)", "$1$1")).otherwise(x)
    full = F.when(F.length(wide) == 6, F.concat(wide, F.lit("FF"))).otherwise(wide)
    part = lambda k: F.conv(F.substring(full, k, 2), 16, 10).cast("int")
    return F.when(
        full.rlike("^[0-9a-fA-F]{8}$"),
        F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), part(7).alias("a"))
    )


def data_uri(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))


def pixels_per_module(modules: Column, size: Column | None, per_module: int = 20) -> Column:
    """Whole pixels for each module, at least 1; from a wanted side if given."""
    if size is None:
        return F.lit(max(1, per_module))
    return F.greatest(F.lit(1), F.floor(size / modules)).cast("int")
