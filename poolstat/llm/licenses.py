"""License scans: Aho-Corasick over words finds notice phrases and identifier tags; a shunting-yard parser reads and
evaluates the expression after a tag.

An expression is read up to the first token that no operator joins, so prose after it is never part of it; its
identifiers must be known (or LicenseRef-...), otherwise it is malformed. `satisfied` tells whether every well-formed
expression can be met by the licenses allowed: `or` needs one side, `and` both, `with` the pair or its license.

Defined results: null, empty and wordless texts have 0 words, no place, empty labels, no expression and score 0;
a malformed expression gives no label; texts of any length are scanned whole; phrases that overlap or repeat count at
every place; repeated rows are scanned alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The method's own phrases and labels.
MORE = {
    "mit license": "mit", "apache license": "apache", "bsd license": "bsd", "mozilla public license": "mpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain": "public-domain",
    "creative commons": "cc", "licensed under": "notice", "copyright": "copyright",
}
TAG = "spdx license identifier"
#: License identifiers and exceptions in lower case.
KNOWN = set(
    "0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 "
    "cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cddl-1.0 cddl-1.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.2 "
    "gfdl-1.3-only gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later isc lgpl-2.0-only lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later "
    "lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-1.1 mpl-2.0 ms-pl ncsa ofl-1.1 openssl osl-3.0 postgresql python-2.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib".split()
)
EXCEPTIONS = set("autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0 gcc-exception-3.1 linux-syscall-note llvm-exception openssl-exception".split())
PERMISSIVE = frozenset("0bsd apache-2.0 bsd-1-clause bsd-2-clause bsd-3-clause bsl-1.0 cc0-1.0 cc-by-4.0 isc mit mit-0 ncsa postgresql python-2.0 unlicense upl-1.0 x11 zlib".split())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9.+\-]+)")
RANK = {"or": 1, "and": 2, "with": 3}
LOWER_AZ = str.maketrans(UPPER, LOWER)


def known(token: str) -> bool:
    return token.removesuffix("+") in KNOWN or token in EXCEPTIONS or token.startswith("licenseref-")


def expression_at(low: str, at: int) -> list[str]:
    """Tokens of the expression that starts at `at` on its line, as far as operands and operators take turns."""
    out, depth, operand = [], 0, True
    while m := TOKEN.match(low, at):
        t = m[1]
        if operand and t == "(":
            depth += 1
        elif operand and t not in RANK and t != ")" and known(t):
            operand = False
        elif not operand and t in RANK:
            operand = True
        elif not operand and t == ")" and depth:
            depth -= 1
        else:
            break
        out.append(t)
        at = m.end()
    # an operator or bracket that leads nowhere was prose
    while out and (out[-1] in RANK or out[-1] == "("):
        out.pop()
    return out


def parse(tokens: list[str] | str) -> list[str]:
    """Shunting-yard: infix tokens (or a text) -> postfix; brackets without a partner are dropped."""
    if isinstance(tokens, str):
        tokens = [m[1] for m in TOKEN.finditer(tokens.translate(LOWER_AZ))]
    out, ops = [], []
    for t in tokens:
        if t in RANK:
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[t]:
                out.append(ops.pop())
            ops.append(t)
        elif t == "(":
            ops.append(t)
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if ops:
                ops.pop()
        else:
            out.append(t)
    return out + [o for o in reversed(ops) if o != "("]


def evaluated(postfix: list[str], allowed: frozenset[str] | set[str]) -> tuple[bool, set[str]]:
    """(satisfied by `allowed`, licenses named); an exception joins its license."""
    stack: list[tuple[bool, set[str]]] = []
    for t in postfix:
        if t not in RANK:
            stack.append((t in allowed, {t}))
        elif len(stack) > 1:
            (b, y), (a, x) = stack.pop(), stack.pop()
            both = {f"{i} with {j}" for i in x for j in y}
            stack.append((a or b, x | y) if t == "or" else (a and b, x | y) if t == "and" else (a or bool(both & allowed), both))
    return bool(stack) and all(ok for ok, _ in stack), set().union(*(names for _, names in stack))


def automaton():
    a = ahocorasick.Automaton()
    for phrase, label in {**MORE, **BASE, TAG: None}.items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def scan_text(text: str | None, machine, allowed: frozenset[str] | set[str]) -> tuple:
    low = (text or "").translate(LOWER_AZ)
    words = WORD.findall(low)
    line = f" {' '.join(words)} "
    hits = [(end - len(p) - 1, p, label) for end, (p, label) in machine.iter(line)]
    labels, base = {x[2] for x in hits if x[2]}, {x[2] for x in hits if x[1] in BASE}
    places, expressions, satisfied = [], [], None
    if hits:
        blanks = [m.start() for m in re.finditer(" ", line)]
        places = [bisect_right(blanks, at) - 1 for at, p, _ in hits if p in BASE]
        tags = [bisect_right(blanks, at) + 1 for at, p, _ in hits if p == TAG]
        ends = [m.end() for m in WORD.finditer(low)] if tags else []
        for last in tags:
            colon = re.compile(r"[ \t]*:[ \t]*").match(low, ends[last])
            tokens = expression_at(low, colon.end()) if colon else []
            if tokens:
                ok, names = evaluated(parse(tokens), allowed)
                labels |= names
                expressions.append(" ".join(tokens).replace("( ", "(").replace(" )", ")"))
                satisfied = ok if satisfied is None else satisfied and ok
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
        1 - 0.5 ** len(labels), ";".join(expressions), satisfied,
    )


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "satisfied"]


def scan(docs: DataFrame, allowed: frozenset[str] | set[str] = PERMISSIVE) -> DataFrame:
    """doc_id, the contract's columns, the expressions found and whether `allowed` satisfies them all (null without one)."""

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, satisfied boolean")
    def found(texts: pd.Series) -> pd.DataFrame:
        machine = automaton()
        df = pd.DataFrame([scan_text(t, machine, allowed) for t in texts], columns=COLUMNS)
        return df.astype({"first_word": "Int64", "last_word": "Int64", "satisfied": "boolean"})

    return docs.select("doc_id", found("text").alias("f")).select("doc_id", "f.*")
