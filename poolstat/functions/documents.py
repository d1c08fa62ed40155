"""Canonical JSON, content hashes and tolerant JSON reading: plain functions, and as pandas UDFs over text columns."""

from __future__ import annotations

import hashlib
import json
import math
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolstat.errors import check

# The fields of a configuration, and the keys of an arm that only document it.
CONFIG_FIELDS = ["harnessVersion", "engineSha", "promptHash", "judgeHash", "embedderId", "armsConfigHash", "corpusHash", "clusterDistanceThreshold"]
DOCUMENTING = {"label", "purpose"}
FENCE = re.compile(r"^```[a-zA-Z]*\s*\n?(.*?)(?:\n?```)?$", re.S)


def _refuse(constant: str):
    raise ValueError(f"{constant} is not JSON")


def decoded(text: str):
    """A JSON text's value; NaN and infinities are refused."""
    return json.loads(text, parse_constant=_refuse)


def _number(x: float) -> str:
    """A finite double as JavaScript prints it: shortest digits, plain for points from -5 to 21, else with an exponent."""
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    d, point = "".join(map(str, digits)), len(digits) + exponent
    if len(d) <= point <= 21:
        text = d + "0" * (point - len(d))
    elif 0 < point <= 21:
        text = f"{d[:point]}.{d[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + d
    else:
        text = d[0] + ("." + d[1:] if len(d) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" + text if sign else text


def stringify(value, ordered: bool = True) -> str:
    """Compact JSON as JavaScript writes it; keys sorted by UTF-16 units when `ordered`, non-finite numbers are null."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass")) if ordered else list(value)
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{stringify(value[k], ordered)}" for k in keys) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(stringify(v, ordered) for v in value) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return str(value) if abs(value) < 1 << 53 else _number(float(value))
    return _number(value) if math.isfinite(value) else "null"


def sha(text: str, length: int = 12) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:length]


def config_hash(config: dict) -> str:
    """Hash of the configuration fields that are present, by sorted name; only the top level is sorted."""
    return sha(stringify({f: config[f] for f in sorted(CONFIG_FIELDS) if f in config}, ordered=False))


def undocumented(value):
    """An arms configuration without what only documents it: keys with a leading underscore, labels and purposes."""
    if isinstance(value, dict):
        return {k: undocumented(v) for k, v in value.items() if not k.startswith("_") and k not in DOCUMENTING}
    return [undocumented(v) for v in value] if isinstance(value, list) else value


def arms_config_hash(config: dict) -> str:
    check(isinstance(config, dict), "an arms configuration is an object")
    return sha(stringify(undocumented(config)))


def pair_set_hash(pairs: list[dict]) -> str:
    """Order-sensitive hash of labelled pairs."""
    return sha(stringify([{k: p[k] for k in ("a", "b", "label")} for p in pairs], ordered=False))


def judge_hash(models: dict[str, list[str]], prompt_hash: str) -> str:
    names = sorted({m for many in models.values() for m in many})
    return sha(stringify({"prompt": prompt_hash, "models": names}, ordered=False))


def judge_request_hash(shape: dict, max_tokens: int | None = None) -> str:
    """Hash of an instrument's request: one token bound, given here or in the shape, and the rest of the shape."""
    own = shape.get("maxTokens")
    check(max_tokens is None or own is None or max_tokens == own, f"two token bounds: {max_tokens} and {own}")
    bound = max_tokens if max_tokens is not None else own
    check(isinstance(bound, int) and bound > 0, f"a positive token bound is needed, got {bound}")
    return sha(stringify({**shape, "maxTokens": bound}))


def content_ids(requests: list) -> list[str]:
    """An id for each request: hash of its canonical JSON and its ordinal among equal ones."""
    seen: dict[str, int] = {}
    out = []
    for r in requests:
        digest = sha(stringify(r), 40)
        out.append(f"r{digest}-{seen.setdefault(digest, 0)}")
        seen[digest] += 1
    return out


def json_body(text: str) -> tuple[str, str]:
    """(what to parse, what to scan): a code fence is dropped, then from the first bracket to the last of its kind."""
    s = text.strip()
    fence = FENCE.match(s)
    s = fence[1].strip() if fence else s
    starts = [i for i in (s.find("["), s.find("{")) if i >= 0]
    if not starts:
        return s, s
    at = min(starts)
    end = s.rfind("]" if s[at] == "[" else "}")
    return (s[at : end + 1] if end > at else s[at:]), s[at:]


def top_objects(s: str) -> tuple[list[dict], int]:
    """Objects at the top level of a broken JSON text, and how many were lost; braces in strings do not count."""
    found, lost, depth, start = [], 0, 0, None
    quoted = False
    for m in re.finditer(r'\\.|"|[{}]', s, re.S):
        c, at = m[0], m.start()
        if len(c) > 1:  # a backslash only escapes inside a string
            c, at = ("", at) if quoted else (c[1], at + 1)
        if c == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif c == "{":
            start = at if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    found.append(decoded(s[start : m.end()]))
                except ValueError:
                    lost += 1
                start = None
    return found, lost + (depth > 0 or quoted)


def salvage(text: str | None) -> tuple[list[dict], bool, int]:
    """(objects, parsed directly, lost) of a reply that should be a JSON array of objects."""
    body, scan = json_body(text or "")
    try:
        value = decoded(body)
        if isinstance(value, dict):
            return [value], True, 0
        if isinstance(value, list):
            return [v for v in value if isinstance(v, dict)], True, 0
    except ValueError:
        pass
    found, lost = top_objects(scan)
    return found, False, lost


@F.pandas_udf(T.StructType().add("objects", T.ArrayType(T.StringType())).add("parsed", T.BooleanType()).add("lost", T.IntegerType()))
def salvaged(texts: pd.Series) -> pd.DataFrame:
    """Canonical JSON of each object of a reply, whether it parsed at once, and how many were lost."""
    rows = [salvage(t) for t in texts]
    return pd.DataFrame({"objects": [[stringify(o, ordered=False) for o in r[0]] for r in rows], "parsed": [r[1] for r in rows], "lost": [r[2] for r in rows]})


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON text with sorted keys; null and unreadable text give null."""

    def one(t):
        try:
            return stringify(decoded(t)) if t is not None else None
        except ValueError:
            return None

    return texts.map(one)


def _rewritten(rewrite):
    """A column of JSON texts -> the canonical JSON of what `rewrite` makes of each value; null and unreadable text give null."""

    @F.pandas_udf(T.StringType())
    def column(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return rewrite(decoded(t)) if t is not None else None
            except ValueError:
                return None

        return texts.map(one)

    return column


#: an arms configuration without its documenting keys at any depth, and a configuration's hashed fields, as canonical text
canonical_arms = _rewritten(lambda v: stringify(undocumented(v)) if isinstance(v, dict) else None)
canonical_config = _rewritten(lambda v: stringify({f: v[f] for f in sorted(CONFIG_FIELDS) if f in v}, ordered=False) if isinstance(v, dict) else None)


@F.pandas_udf(T.StringType())
def canonical_judge_request(texts: pd.Series, bounds: pd.Series) -> pd.Series:
    """Canonical text of judges' request shapes with their one token bound, given in the shape or beside it; without one, or with two that differ, null."""

    def one(t, bound):
        try:
            shape = decoded(t) if t is not None else None
        except ValueError:
            return None
        if not isinstance(shape, dict):
            return None
        own = shape.get("maxTokens")
        given = None if pd.isna(bound) else int(bound)
        use = given if given is not None else own
        fits = isinstance(use, int) and not isinstance(use, bool) and use > 0 and (own is None or given is None or own == given)
        return stringify({**shape, "maxTokens": use}) if fits else None

    return pd.Series([one(t, b) for t, b in zip(texts, bounds)], dtype=object)
