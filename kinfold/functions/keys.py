"""Canonical match keys as SQL text that Spark and DuckDB both run.

Every builder takes the text of a column expression and returns the text of an expression, so one definition serves the engine
and the oracle. Null in gives null out; text of any length is handled by linear regular expressions.
"""

from __future__ import annotations

# White space removed at both ends of a value.
OUTER_SPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Words that stand for "no value".
PLACEHOLDERS = ("n/a", "na", "none", "null", "unknown", "tbd")
# Local parts of shared mailboxes.
ROLE_LOCALPARTS = ("info", "team", "hello", "contact", "admin", "support", "office", "sales", "hi", "events", "press", "careers", "jobs")

DIALECTS = ("spark", "duckdb")


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sub(expr: str, pattern: str, to: str = "", dialect: str = "spark") -> str:
    """Replace every match. Spark reads back-slashes in literals, so the pattern goes in as a raw literal."""
    if dialect == "spark":
        return f"regexp_replace({expr}, r'{pattern}', '{to}')"
    return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"


def like(expr: str, pattern: str, dialect: str = "spark") -> str:
    if dialect == "spark":
        return f"({expr} rlike r'{pattern}')"
    return f"regexp_matches({expr}, '{pattern}')"


def trimmed(expr: str, dialect: str = "spark") -> str:
    if dialect == "spark":
        return f"trim(both '{OUTER_SPACE}' from {expr})"
    return f"trim({expr}, '{OUTER_SPACE}')"


def is_blank(expr: str, dialect: str = "spark") -> str:
    """True for null, for text without a letter or digit, and for the placeholder words."""
    return f"({expr} is null or not {like(expr, '[\\p{L}\\p{Nd}]', dialect)} or lower({trimmed(expr, dialect)}) in ({_quoted(PLACEHOLDERS)}))"


def let(expr: str, name: str, body: str, dialect: str = "spark") -> str:
    """`body` with `name` standing for the value of `expr`, which is computed once."""
    if dialect == "spark":
        return f"get(transform(array({expr}), {name} -> {body}), 0)"
    return f"list_transform([{expr}], lambda {name}: {body})[1]"


def email_key(expr: str, dialect: str = "spark") -> str:
    """Lower-case address, or null without @, with an inner blank, an empty local part, or a domain undotted or ending in a dot."""
    v = f"lower({trimmed(expr, dialect)})"
    return f"(case when {like(v, '^[^@ ]+@[^ ]*[.][^ ]*[^ .]$', dialect)} then {v} end)"


def handle_key(expr: str, dialect: str = "spark") -> str:
    """Bare lower-case handle from a handle, an @handle or a profile URL; null unless only a-z, 0-9 and _ remain."""
    v = f"lower({trimmed(expr, dialect)})"
    v = sub(sub(v, "^(https?://)?(www[.]|m[.])?x[.]example/([^/?#]*).*$", "$3" if dialect == "spark" else "\\3", dialect), "^@", "", dialect)
    return let(v, "h", f"case when {like('h', '^[a-z0-9_]+$', dialect)} then h end", dialect)


def phone_key(expr: str, dialect: str = "spark") -> str:
    """Digits with country code; an extension is dropped, + or 00 marks the code, ten digits alone get 1."""
    v = sub(sub(f"lower({expr})", "[x][^0-9]*[0-9]+[^0-9]*$", "", dialect), "[^0-9+]", "", dialect)
    digits = "replace(p, '+', '')"
    body = (
        f"case when {digits} = '' then null when substring(p, 1, 1) = '+' then {digits} when substring(p, 1, 2) = '00' then nullif(substring({digits}, 3), '')"
        f" when length({digits}) = 10 then concat('1', {digits}) else {digits} end"
    )
    return let(v, "p", body, dialect)


def linkedin_key(expr: str, dialect: str = "spark") -> str:
    """Profile URL in lower case without scheme, www. or m., query and last slash; null for blank text."""
    v = f"lower({trimmed(expr, dialect)})"
    for pattern in ("^https?://", "^(www[.]|m[.])", "[?].*$", "/$"):
        v = sub(v, pattern, "", dialect)
    return f"(case when {is_blank(expr, dialect)} then null else nullif({v}, '') end)"


KEY_BUILDERS = {"email": email_key, "phone": phone_key, "linkedin_url": linkedin_key, "handle": handle_key}


def is_role_email(key_expr: str, dialect: str = "spark") -> str:
    """True when a canonical address is a shared mailbox."""
    return f"(split_part({key_expr}, '@', 1) in ({_quoted(ROLE_LOCALPARTS)}))"
