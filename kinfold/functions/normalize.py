"""Normalisers and text functions as SQL text that Spark and DuckDB both run (see keys.py for the convention)."""

from __future__ import annotations

import unicodedata

from kinfold.functions.keys import like, sub, trimmed

# Stroked letters without a decomposition, and the letters they fold to.
STROKES = {"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ŀ": "l", "ı": "i", "ȷ": "j", "ƒ": "f"}
LIGATURES = {"æ": "ae", "œ": "oe"}
# First path segments of profile hosts that are routes, not people.
TWITTER_ROUTES = ("i", "intent", "home", "search", "hashtag", "explore", "share", "settings", "messages", "notifications")
GITHUB_ROUTES = ("orgs", "features", "topics", "trending", "settings", "marketplace", "sponsors", "about")
# Days until a current value is due again, by field.
REFRESH_DAYS = {"current_role": 90, "current_company": 90, "company_category": 90, "location": 180, "email_status": 180}
# Closeness by channel and its rank.
CHANNEL_TIER = {
    "irl": "t1_irl_messaging", "imessage": "t1_irl_messaging", "whatsapp": "t1_irl_messaging", "telegram": "t1_irl_messaging", "signal": "t1_irl_messaging",
    "linkedin": "t2_dm", "instagram": "t2_dm", "slack_dm": "t2_dm", "discord_dm": "t2_dm", "email": "t2_dm",
    "community": "t3_community", "slack": "t3_community", "discord": "t3_community", "twitter": "t4_public",
}
TIER_RANK = {"t1_irl_messaging": 4, "t2_dm": 3, "t3_community": 2, "t4_public": 1, "none": 0}
AUTO_MERGE, REVIEW_BAND, CONFLICT_SCORE = 0.92, 0.55, 0.75


def _accent_table() -> tuple[str, str]:
    """Letters up to U+1EFF whose decomposition is one plain letter and marks, and that letter: made by rule, not listed."""
    src, dst = "", ""
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1 and base.isascii() and c.lower() == c:
            src, dst = src + c, dst + base
    return src + "".join(STROKES), dst + "".join(STROKES.values())


_SRC, _DST = _accent_table()


def unaccent_lower(expr: str, dialect: str = "spark") -> str:
    """Lower case without accents; the same table in both engines. Letters outside Latin are kept."""
    v = f"lower({expr})"
    for a, b in LIGATURES.items():
        v = f"replace({v}, '{a}', '{b}')"
    return sub(f"translate({v}, '{_SRC}', '{_DST}')", "[̀-ͯ]", "", dialect)


def trigrams(expr: str, dialect: str = "spark") -> str:
    """Distinct trigrams of the words of a text, each word padded by two blanks before and one after; [] for null."""
    v = f"coalesce({unaccent_lower(expr, dialect)}, '')"
    if dialect == "spark":
        words = f"filter(split({v}, '[^a-z0-9]+'), w -> w <> '')"
        return f"array_distinct(flatten(transform({words}, w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"
    words = f"list_filter(regexp_split_to_array({v}, '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i::int, 3)))))"


def linkedin_profile(expr: str, dialect: str = "spark", host: str = "linkedin.example") -> str:
    """host/in/slug of a person's profile URL; null for companies, other hosts and anything else."""
    v = sub(f"lower({trimmed(expr, dialect)})", "^https?://", "", dialect)
    v = sub(unescaped(sub(sub(v, "^(www[.]|m[.])", "", dialect), "[?#].*$", "", dialect), dialect), "/+$", "", dialect)
    return f"(case when {like(v, '^' + host.replace('.', '[.]') + '/in/[^/]+', dialect)} then {v} end)"


def social_handle(expr: str, hosts: tuple[str, ...], charset: str, routes: tuple[str, ...], most: int, dialect: str = "spark") -> str:
    """Bare lower-case handle of a URL, @handle or handle; null on other hosts, site routes and odd characters."""
    v = sub(f"lower({trimmed(expr, dialect)})", "^@", "", dialect)
    host = "|".join(h.replace(".", "[.]") for h in hosts)
    path = sub(v, f"^(https?://)?(www[.]|mobile[.])?({host})/+([^/?#]*).*$", "$4" if dialect == "spark" else "\\4", dialect)
    listed = ", ".join(f"'{r}'" for r in routes)
    return f"(case when {path} not in ({listed}) and {like(path, charset, dialect)} and length({path}) <= {most} then {path} end)"


def twitter_handle(expr: str, dialect: str = "spark") -> str:
    return social_handle(expr, ("twitter.com", "x.com", "x.example"), "^[a-z0-9_]+$", TWITTER_ROUTES, 15, dialect)


def github_handle(expr: str, dialect: str = "spark") -> str:
    return social_handle(expr, ("github.com", "github.example"), "^[a-z0-9]+(-[a-z0-9]+)*$", GITHUB_ROUTES, 39, dialect)


def e164(expr: str, dialect: str = "spark") -> str:
    """+digits of a phone number with 8 to 15 digits, ten digits taken as North American; extensions are dropped."""
    from kinfold.functions.keys import phone_key

    k = phone_key(expr, dialect)
    return f"(case when length({k}) between 8 and 15 then concat('+', {k}) end)"


def full_name(first: str, last: str) -> str:
    """First and last name joined, blanks left out; null when both are missing."""
    return f"nullif(trim(concat_ws(' ', nullif(trim({first}), ''), nullif(trim({last}), ''))), '')"


def refresh_after(field: str, method: str, day: str) -> str:
    """The day a value is due for a check: never for manual ones and stable fields."""
    cases = " ".join(f"when {field} in ({', '.join(repr(f) for f, n in REFRESH_DAYS.items() if n == days)}) then {day} + interval '{days}' day" for days in sorted(set(REFRESH_DAYS.values())))
    return f"cast(case when {method} = 'manual_set' then null {cases} end as date)"


def tier_of(channel: str) -> str:
    """Closeness tier of a channel; the look-up is case-sensitive, null for unknown channels."""
    cases = " ".join(f"when {channel} in ({', '.join(repr(c) for c, t in CHANNEL_TIER.items() if t == tier)}) then '{tier}'" for tier in TIER_RANK if tier != "none")
    return f"(case {cases} end)"


def rank_of(tier: str) -> str:
    return "(case " + " ".join(f"when {tier} = '{t}' then {r}" for t, r in TIER_RANK.items()) + " else 0 end)"


def truncated(expr: str, most: int = 140) -> str:
    """Trimmed text cut to `most` characters with an ellipsis; '' for null."""
    return f"(case when {expr} is null then '' when length(trim({expr})) <= {most} then trim({expr}) else concat(rtrim(substring(trim({expr}), 1, {most})), '…') end)"


def facet_gate(field: str, value: str, detail: str, dialect: str = "spark") -> str:
    """Why an agent's claim is refused: rejected_bad_facet, rejected_ungrounded, or null when it may proceed."""
    facet = like(f"coalesce(trim({value}), '')", "^(tool|skill|role|domain):[a-z0-9-]+$", dialect)
    return f"(case when {field} = 'expertise' and not {facet} then 'rejected_bad_facet' when {field} in ('origin_context', 'notes', 'expertise') and length(trim(coalesce({detail}, ''))) < 20 then 'rejected_ungrounded' end)"


def noreply_login(email: str, dialect: str = "spark", host: str = "users.noreply.github.com") -> str:
    """Login in a code host's noreply address, with or without the leading number."""
    v = f"lower(trim({email}))"
    pattern = "^([0-9]+[+])?([a-z0-9-]+)@" + host.replace(".", "[.]") + "$"
    return f"(case when {like(v, pattern, dialect)} then {sub(v, pattern, '$2' if dialect == 'spark' else chr(92) + '2', dialect)} end)"


def apple_date(expr: str, dialect: str = "spark") -> str:
    """UTC date of a count of seconds or nanoseconds since 2001; above 10^10 it counts nanoseconds."""
    seconds = f"cast(case when {expr} > 10000000000 then {expr} {'div' if dialect == 'spark' else '//'} 1000000000 else {expr} end + 978307200 as bigint)"
    return f"cast(timestamp_seconds({seconds}) as date)" if dialect == "spark" else f"cast(to_timestamp({seconds}) at time zone 'UTC' as date)"


def intent_tokens(intent: str, stop: frozenset[str]) -> list[str]:
    """Distinct lower-case words of a query of three letters or more that are no stop words, in order."""
    import re

    return list(dict.fromkeys(t for t in re.findall(r"[a-z0-9][a-z0-9-]+", intent.lower()) if t not in stop and len(t) >= 3))


def plain_name(expr: str, dialect: str = "spark") -> str:
    """A name without accents and case, white space folded; null when nothing is left."""
    return f"nullif(trim({sub(unaccent_lower(expr, dialect), '[\\s\u00a0]+', ' ', dialect)}), '')"


def confidence_class(score: str) -> str:
    """auto, review or none, by the thresholds of a resolution run."""
    return f"(case when {score} >= {AUTO_MERGE} then 'auto' when {score} >= {REVIEW_BAND} then 'review' else 'none' end)"


def is_social(url: str, hosts: tuple[str, ...]) -> str:
    """Whether an address names one of the social hosts."""
    return "(" + " or ".join(f"coalesce(lower({url}) like '%{h}%', false)" for h in hosts) + ")"


def evidence(detail: str, quote: str) -> str:
    """What a fact rests on: detail and quote joined by a dot, blanks left out; null when both are missing."""
    return f"nullif(concat_ws(' · ', nullif(trim({detail}), ''), nullif(trim({quote}), '')), '')"


def unescaped(expr: str, dialect: str = "spark") -> str:
    """Percent-decoded text; a text that does not decode stays as it is. A plus sign is kept."""
    if dialect == "spark":
        return f"coalesce(try_url_decode(replace({expr}, '+', '%2B')), {expr})"
    return f"(case when {like(expr, '%([^0-9A-Fa-f]|[0-9A-Fa-f]([^0-9A-Fa-f]|$)|$)', dialect)} then {expr} else url_decode({expr}) end)"


def canonical_identifier(kind: str, value: str, dialect: str = "spark") -> str:
    """The canonical form of an identifier by its kind; null for other kinds."""
    from kinfold.functions.keys import KEY_BUILDERS

    return "(case " + " ".join(f"when {kind} = '{k}' then {build(value, dialect)}" for k, build in KEY_BUILDERS.items()) + " end)"
