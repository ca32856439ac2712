"""Permission masks, role and resource names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Permission bits, and what each permission brings with it.
BITS = {"READ": 1, "WRITE": 2, "CREATE": 4, "DELETE": 8, "ADMIN": 16, "DOWNLOAD": 32, "UPLOAD": 64}
IMPLIED = {"DOWNLOAD": ("READ",), "UPLOAD": ("WRITE", "READ"), "WRITE": ("READ",), "ADMIN": tuple(BITS)}
DOMAIN_LEVEL = ("*", "__domain__", "__root__")
SYNONYMS = {"access": "read", "view": "read", "manage": "write"}


def has(mask: Column, permission: str) -> Column:
    return mask.bitwiseAND(F.lit(BITS[permission])) != 0


def permissions(mask: Column) -> Column:
    """Sorted names of a mask's permissions and of those they imply."""
    none = F.array().cast("array<string>")
    parts = [F.when(has(mask, p), F.array(*[F.lit(x) for x in (p, *IMPLIED.get(p, ()))])).otherwise(none) for p in BITS]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def actions(mask: Column) -> Column:
    """The policy actions a mask grants: read, write, admin."""
    names = permissions(mask)
    return F.filter(F.array(*[F.when(F.array_contains(names, a.upper()), F.lit(a)) for a in ("read", "write", "admin")]), lambda a: a.isNotNull())


def role_name(role: Column) -> Column:
    """Without ``ROLE_``, trimmed, upper case."""
    return F.upper(F.regexp_replace(F.trim(role), "(?i)^ROLE_", ""))


def action_name(action: Column) -> Column:
    """Lower case, synonyms resolved."""
    known = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    name = F.lower(F.trim(action))
    return F.coalesce(F.element_at(known, name), name)


def resource(key: Column, aliases: dict[str, str] | None = None) -> Column:
    """``domain`` and ``component`` of a ``domain:component`` key; the component is null at domain level."""
    text = F.lower(F.trim(key))
    domain = F.split_part(text, F.lit(":"), F.lit(1))
    if aliases:
        known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        domain = F.coalesce(F.element_at(known, domain), domain)
    component = F.when(F.instr(text, ":") > 0, F.split_part(text, F.lit(":"), F.lit(2)))
    return F.struct(domain.alias("domain"), F.when(component.isin(*DOMAIN_LEVEL) | (component == ""), None).otherwise(component).alias("component"))
