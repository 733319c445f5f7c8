"""Profile sources of enrichment facts. The transport is a function (url, headers) -> (status, headers, body), so that tests and offline
runs use stored responses; the default uses the standard library with bounded retries. A header `method` names another method than GET."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Transport = Callable[[str, dict], tuple[int, dict, bytes]]
# Hosts that are social profiles, not personal sites.
SOCIAL_HOSTS = ("twitter.com", "x.com", "instagram.com", "facebook.com", "linkedin.com", "github.com", "youtube.com", "tiktok.com", "mastodon", "threads.net")
FACTS = "contact_id string, source string, field string, value string, kind string, confidence double"
# Confidence of a self-published profile and of a code host's user record.
PROFILE_CONFIDENCE, ACCOUNT_CONFIDENCE = 0.9, 0.85


def plain_transport(url: str, headers: dict, timeout: float = 10.0) -> tuple[int, dict, bytes]:
    try:
        asked = urllib.request.Request(url, headers={k: v for k, v in headers.items() if k != "method"}, method=headers.get("method"))
        with urllib.request.urlopen(asked, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), b""
    except (urllib.error.URLError, TimeoutError, OSError):
        return 0, {}, b""


def fetch(transport: Transport, url: str, headers: dict, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[int, bytes]:
    """A response after at most `retries` waits on status 429: what Retry-After says up to a minute, else doubling with jitter."""
    for n in range(retries + 1):
        status, got, body = transport(url, headers)
        if status != 429 or n == retries:
            return status, body
        wait = got.get("Retry-After", "")
        sleep(min(60.0, float(wait)) if str(wait).isdigit() else 2**n + random.random())
    return 0, b""


def is_social(url: str) -> bool:
    return any(h in url.lower() for h in SOCIAL_HOSTS)


def mail_hash(email: str) -> str:
    return hashlib.sha256(email.strip().lower().encode()).hexdigest()


def _told(confidence: float, *pairs: tuple[str, object]) -> list[tuple[str, str, float]]:
    """Facts of the values that are not blank."""
    return [(field, str(value).strip(), confidence) for field, value in pairs if value and str(value).strip()]


def _json(status: int, body: bytes) -> dict:
    """The object of a sound response, else an empty one."""
    try:
        found = json.loads(body) if status == 200 else {}
    except ValueError:
        found = {}
    return found if isinstance(found, dict) else {}


class ProfileSource:
    """Public profile by the hash of a mail address: the avatar, where one exists, and five fields; the name is never taken over."""

    name, produces, interval = "gravatar", ("avatar_url", "location", "current_role", "current_company", "twitter_username", "website_url"), 60 / 50

    def facts(self, email: str, transport: Transport) -> list[tuple[str, str, float]]:
        if "@" not in email:
            return []
        key = mail_hash(email)
        avatar = f"https://gravatar.com/avatar/{key}"
        there, _ = fetch(transport, avatar + "?d=404", {"method": "HEAD"})
        p = _json(*fetch(transport, f"https://api.gravatar.com/v3/profiles/{key}", {}))
        accounts = ((a.get("shortname") or a.get("service_label") or "", a.get("username")) for a in p.get("verified_accounts") or [])
        twitter = next((user for kind, user in accounts if kind.lower() == "twitter" and user), None)
        links = ((x.get("url") or "").strip() for x in p.get("links") or [])
        site = next((url for url in links if url and not is_social(url)), None)
        return _told(PROFILE_CONFIDENCE, ("avatar_url", avatar if there == 200 else None), ("location", p.get("location")), ("current_company", p.get("company")), ("current_role", p.get("job_title")), ("twitter_username", twitter), ("website_url", site))


class CodeHostSource:
    """Account of a code host and its user record: the login from a noreply address, else by a search with exactly one hit, for which
    a token is needed."""

    name, produces, interval = "github", ("github_username", "avatar_url", "current_company", "location", "website_url", "twitter_username"), 60 / 10

    def __init__(self, token: str | None = None):
        self.headers = {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28", **({"Authorization": f"Bearer {token}"} if token else {})}
        self.token = token

    def login(self, email: str, transport: Transport) -> str | None:
        if m := re.fullmatch(r"(?:\d+\+)?([a-z\d-]+)@users\.noreply\.github\.com", email.strip().lower()):
            return m[1]
        if not self.token:
            return None
        found = _json(*fetch(transport, f"https://api.github.com/search/users?q={urllib.parse.quote(email)}", self.headers))
        items = found.get("items") or []
        return items[0].get("login") if found.get("total_count") == 1 and items else None

    def facts(self, email: str, transport: Transport) -> list[tuple[str, str, float]]:
        login = self.login(email, transport) if "@" in email else None
        if not login:
            return []
        status, body = fetch(transport, f"https://api.github.com/users/{login}", self.headers)
        u = _json(status, body)
        if not u:
            return []
        return _told(ACCOUNT_CONFIDENCE, ("github_username", login), ("avatar_url", f"https://github.com/{login}.png"), ("current_company", u.get("company")), ("location", u.get("location")), ("website_url", u.get("blog")), ("twitter_username", u.get("twitter_username")))


SOURCES = {s.name: s for s in (ProfileSource, CodeHostSource)}


def select_sources(names: list[str] | None = None) -> list:
    """Sources in their fixed order; unknown names are dropped."""
    return [s() for n, s in SOURCES.items() if names is None or n in {x.strip() for x in names}]


def gather(emails: DataFrame, sources: list, transport: Transport = plain_transport, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Facts of (contact_id, email) rows, fetched inside the partitions at each source's pace; coalesce the input to keep within a
    source's rate. A source that fails gives no fact."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for contact, email in zip(pdf["contact_id"], pdf["email"]):
                for s in sources:
                    if isinstance(email, str) and email:
                        try:
                            rows += [(contact, s.name, f, v, "attribute", c) for f, v, c in s.facts(email, transport)]
                        except (ValueError, KeyError, TypeError):
                            continue
                        pause(s.interval)
            yield pd.DataFrame(rows, columns=["contact_id", "source", "field", "value", "kind", "confidence"])

    return emails.select("contact_id", "email").mapInPandas(run, FACTS)
