"""Privacy classes and structural shapes of corpus values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.catalog import dims
from watchloom.functions.lookup import let
from watchloom.functions.sqltext import literal_array


def tokenize_name(name: Column) -> Column:
    """Split a dotted, Pascal-case or snake-case path into lower-case words."""
    spaced = F.translate(name, "._", "  ")
    tokens = F.regexp_extract_all(spaced, F.lit(dims.NAME_TOKEN), F.lit(0))
    return F.transform(tokens, F.lower)


def value_class(value: Column) -> Column:
    """The first matching shape of a text value, null when none matches.

    Every shape holds one of a few signs, so plain words are told apart by one cheap test."""
    shapes = (
        F.when(value.rlike(dims.IPV4), "ipv4")
        .when(value.rlike(dims.IPV4_PORT), "ipv4:port")
        .when(value.rlike(dims.IPV6_PORT), "ipv6:port")
        .when(value.rlike(dims.ACCOUNT), "account")
        .when(value.rlike(dims.GUID), "guid")
        .when(value.rlike(dims.EMAIL), "email")
        .when(value.rlike(dims.SID), "sid")
        .when(value.rlike(dims.FQDN), "fqdn")
    )
    return F.when(value.rlike(r"[-.:@\\]"), shapes)


def is_identifier_value(value: Column) -> Column:
    """The value alone gives an entity away, whatever the field is called."""
    return F.coalesce(value_class(value), F.lit("fqdn")) != "fqdn"


def name_kind(name: Column) -> Column:
    """What the field name alone says: ``freeform``, ``identifier`` or null."""
    words = tokenize_name(name)
    return (
        F.when(F.arrays_overlap(words, F.expr(literal_array(dims.FREEFORM_WORDS))), "freeform")
        .when(F.arrays_overlap(words, F.expr(literal_array(dims.IDENTIFIER_WORDS))), "identifier")
    )


def classify_field(name: Column, value: Column, shape: Column | None = None) -> Column:
    """``identifier`` or ``freeform``: value shape first, then name words, then host names.

    ``value`` is null where it is not text; pass its ``value_class`` as ``shape`` if it is known.
    """
    if shape is None:
        return let(value_class(value), lambda known: classify_field(name, value, known))
    short = F.size(F.split(value, r"\.")) <= 4
    return (
        F.when(shape.isNotNull() & (shape != "fqdn"), "identifier")
        .otherwise(F.coalesce(name_kind(name), F.when((shape == "fqdn") & short, "identifier").otherwise("freeform")))
    )


def len_bucket(length: Column) -> Column:
    out = None
    for edge in dims.LENGTH_EDGES:
        hit = length <= edge
        out = F.when(hit, f"<={edge}") if out is None else out.when(hit, f"<={edge}")
    return out.otherwise(f">{dims.LENGTH_EDGES[-1]}")


def shape_token(value: Column, kind: Column | None = None) -> Column:
    """A structural signature of a text value; never the value itself. ``kind`` is its
    ``value_class`` if that is known."""
    if kind is None:
        return let(value_class(value), lambda known: shape_token(value, known))
    labels = lambda text: F.size(F.split(text, r"\.")).cast("string")
    local = F.substring_index(value, "@", 1)
    host = F.substring_index(value, "@", -1)
    return (
        F.when(kind.isin("ipv4", "ipv4:port", "ipv6:port", "guid"), kind)
        .when(kind == "account", "account:domain_user")
        .when(kind == "email", F.concat(
            F.lit("email:local_len="), F.length(local).cast("string"),
            F.lit(":domain_labels="), labels(host)))
        .when(kind == "sid", F.concat(F.lit("sid:parts="), F.size(F.split(value, "-")).cast("string")))
        .when(kind == "fqdn", F.concat(F.lit("fqdn:labels="), labels(value)))
        .otherwise(F.concat(F.lit("str:len_bucket="), len_bucket(F.length(value))))
    )


def linux_auth_failed(message: Column) -> Column:
    """A login message that tells of a failure."""
    return F.lower(message).rlike(dims.AUTH_FAILED)
