"""URL filters by a bit-parallel wildcard automaton over canonical URLs.

All glob rules lie in one multiword Shift-And mask (a Python integer spans as many words as it needs); one step per
character moves every pattern at once. The method's globs judge the canonical URL: scheme and host in lower case,
without user, default port and final dot, percent-encoded unreserved characters decoded, dot segments and repeated
slashes removed, no fragment. The fixed rules judge the raw host and path in the same automaton, marked apart.

Defined results: null urls and urls without `://` have empty host and path, fit no rule and are allowed; of rules of one
length the first wins; repeated pages are judged alike; urls of any length are read whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az

#: The rules (host, path, verdict); the longest that fits wins.
RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
]
#: The method's own globs over canonical URLs; they block where no rule fits. Words stand for whole labels or segments.
GLOBS = [
    *[f"*://*.{w}.*/*" for w in ("casino", "poker", "jackpot", "porn", "xxx", "viagra", "payday-loans")],
    *[f"*://{w}.*/*" for w in ("casino", "poker", "jackpot", "porn", "xxx", "viagra", "ads", "adserver", "tracking")],
    *[f"*://*/{w}/*" for w in ("casino", "online-poker", "porn", "cheap-pills", "cgi-bin", "wp-admin", "checkout", "cart")],
    *[f"*://*/{w}" for w in ("wp-login.php", "xmlrpc.php", "robots.txt")],
    "*://*?*sessionid=*", "*://*?*phpsessid=*", "*://*.onion/*", "*://*/*.exe",
]
EDGE, RAW, CANONICAL = "\x00", "\x01", "\x02"
UNRESERVED = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
PORTS = {"http": ":80", "https": ":443", "ftp": ":21"}


class ShiftAnd:
    """Glob patterns (`*` any run, `?` any one; `[?]` stands for the sign itself) matched together."""

    def __init__(self, globs: list[str]):
        self.start = self.loops = self.any = self.ends = 0
        self.masks: dict[str, int] = {}
        self.owner: dict[int, int] = {}
        at = 0
        for k, glob in enumerate(globs):
            self.start |= 1 << at  # on before the first character, and stays on after `*`
            for ch in re.findall(r"\[.\]|.", glob, re.S):
                if ch == "*":
                    self.loops |= 1 << at
                    continue
                at += 1
                if ch == "?":
                    self.any |= 1 << at
                else:
                    self.masks[ch[-2] if len(ch) == 3 else ch] = self.masks.get(ch[-2] if len(ch) == 3 else ch, 0) | 1 << at
            self.ends |= 1 << at
            self.owner[at] = k
            at += 1

    def match(self, text: str) -> list[int]:
        d, masks, any_, loops = self.start, self.masks, self.any, self.loops
        for ch in text:
            d = (d << 1 & (masks.get(ch, 0) | any_)) | (d & loops)
            if not d:
                return []
        hit, out = d & self.ends, []
        while hit:
            low = hit & -hit
            out.append(self.owner[low.bit_length() - 1])
            hit ^= low
        return sorted(out)


def _decoded(text: str) -> str:
    """Percent-encoded unreserved characters as themselves, the rest in upper-case hex."""

    def one(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if c in UNRESERVED else m[0].upper()

    return re.sub(r"%([0-9A-Fa-f]{2})", one, text)


def canonical(url: str) -> str:
    """A URL in the form globs are written for; empty without `://`."""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return ""
    scheme = scheme.lower()
    m = re.match(r"([^/?#]*)([^?#]*)(\?[^#]*)?", rest, re.S)
    host = m[1].rpartition("@")[2].lower().removesuffix(PORTS.get(scheme, "\n"))
    host = re.sub(r"\.+(?=$|:)", "", host)
    out: list[str] = []
    parts = re.sub("/+", "/", _decoded(m[2])).split("/")[1:]
    for k, part in enumerate(parts):
        if part == "..":
            out = out[:-1]
        elif part != ".":
            out.append(part)
            continue
        if k == len(parts) - 1:
            out.append("")
    return f"{scheme}://{host}/{'/'.join(out)}{_decoded(m[3] or '')}"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = lower_az(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(pages: DataFrame, rules=RULES, globs=GLOBS) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, glob (the method's first that fits), canonical_url."""
    literal = lambda t: re.sub(r"([*?\[])", r"[\1]", t)
    own = [re.sub(r"(?<=\*)\?(?=\*)", "[?]", g) for g in globs]  # a lone ? between stars is the sign of a query
    machine = ShiftAnd([f"{RAW}*.{literal(h)}{EDGE}{literal(p)}*" for h, p, _ in rules] + [CANONICAL + g for g in own])
    plain = re.compile("[\x00-\x02]")

    @F.pandas_udf("rule string, verdict string, glob string, canonical_url string")
    def decide(url: pd.Series, host: pd.Series, path: pd.Series) -> pd.DataFrame:
        out = []
        for u, h, p in zip(url, host, path):
            whole = canonical(u or "")
            fits = machine.match(f"{RAW}.{plain.sub(' ', h)}{EDGE}{plain.sub(' ', p)}")
            mine = machine.match(CANONICAL + plain.sub(" ", whole)) if whole else []
            best = max(fits, key=lambda k: (len(rules[k][0]) + len(rules[k][1]), -k), default=None)
            verdict = rules[best][2] if best is not None else "block" if mine else "allow"
            out.append((None if best is None else rules[best][0] + rules[best][1], verdict, globs[mine[0] - len(rules)] if mine else None, whole))
        return pd.DataFrame(out, columns=["rule", "verdict", "glob", "canonical_url"])

    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("j", decide("url", "host", "path"))
    return rows.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "j.*")
