"""Licence scans: Aho-Corasick over notice phrases and identifier tags; licence expressions by a shunting yard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import TEXT_ROWS, stage
from loomwork.llm.words import WordAutomaton, offsets, words_of

#: The contract's phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Names of licences as notices write them, and their labels.
NAMES = {
    "mit license": "mit",
    "expat license": "mit",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl-1.0",
    "boost software license version 1 0": "bsl-1.0",
    "apache license": "apache",
    "apache license 2 0": "apache-2.0",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "simplified bsd license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "modified bsd license": "bsd-3-clause",
    "python software foundation license": "psf",
    "artistic license": "artistic",
    "gnu gpl": "gpl",
    "gnu general public license": "gpl",
    "gnu lgpl": "lgpl",
    "lesser general public license": "lgpl",
    "gnu lesser general public license": "lgpl",
    "gnu agpl": "agpl",
    "affero general public license": "agpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons zero": "cc0",
    "open data commons open database license": "odbl",
    "sil open font license": "ofl",
    "business source license": "busl",
    "server side public license": "sspl",
    "unlicense": "unlicense",
}
#: How a notice puts a text under a licence, and how far that shows it; a bare name shows less.
GRANTS = {
    "{}": 0.7,
    "licensed under the {}": 0.95,
    "licenced under the {}": 0.95,
    "released under the {}": 0.95,
    "distributed under the {}": 0.95,
    "available under the {}": 0.95,
    "published under the {}": 0.95,
    "under the terms of the {}": 0.95,
    "governed by the {}": 0.9,
    "subject to the {}": 0.85,
}
#: Sentences of licence texts and other notices, their labels, and how far one alone shows that the text is under it.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "the software is provided as is without warranty of any kind": ("mit", 0.6),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.95),
    "redistribution and use in source and binary forms with or without modification": ("bsd", 0.95),
    "neither the name of the copyright holder nor the names of its contributors": ("bsd-3-clause", 0.9),
    "unless required by applicable law or agreed to in writing software distributed under the license": ("apache-2.0", 0.9),
    "this program is free software you can redistribute it and or modify it": ("gpl", 0.9),
    "this library is free software you can redistribute it and or modify it": ("lgpl", 0.9),
    "this source code form is subject to the terms of the mozilla public license": ("mpl", 0.95),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.95),
    "to the extent possible under law": ("cc0", 0.6),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "cc0 1 0": ("cc0", 0.9),
    "public domain": ("public-domain", 0.5),
    "dedicated to the public domain": ("public-domain", 0.9),
    "no part of this publication may be reproduced": ("reserved", 0.9),
    "proprietary and confidential": ("proprietary", 0.9),
}
NOTICES |= {how.format(name): (label, weight) for how, weight in GRANTS.items() for name, label in NAMES.items()}
BASE_WEIGHT = {"cc-by": 0.8, "gpl": 0.8, "reserved": 0.7}
#: A tag is followed by a colon or an equals sign, quoted or not; without one the words are prose.
TAGS = ("spdx license identifier", "license expression", "license spdx")
_AFTER = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")
#: What one may do under a licence, from least to most restricted; families are told by an identifier's first parts.
TERMS = ("permissive", "copyleft", "restricted", "unknown")
FAMILIES = {
    "permissive": "0bsd afl apache artistic blueoak bsd bsl cc-by cc0 curl ecl fsfap ftl hpnd ijg isc json libpng mit ms-pl mulanpsl "
    "ncsa odc-by ofl openssl pddl php postgresql psf public-domain python ruby tcl unicode unlicense upl vim w3c wtfpl x11 zlib zpl",
    "copyleft": "agpl cc-by-sa cddl cecill cpl epl eupl gfdl gpl ipl lgpl lppl mpl ms-rl odbl osl qpl sleepycat",
    "restricted": "busl cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd elastic polyform-noncommercial proprietary reserved sspl",
}
_FAMILY = {name: kind for kind, names in FAMILIES.items() for name in names.split()}
#: What may follow a family in an identifier: versions and the words of its variants.
_VARIANT = re.compile(r"v?\d[\d.]*[a-z]?|only|or|later|clause|clear|patent|no|nuclear|modification|license|perl|cl8|rfn|invariants|dfs|tou|igo")
#: Identifiers that a document defines itself.
_OWN = ("licenseref-", "documentref-")
_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*(?:([A-Za-z0-9][A-Za-z0-9.\-+:]*)|([()]))")


class BadExpression(ValueError):
    pass


def postfix(expression: str) -> list[str]:
    """A licence expression in postfix order, by the shunting-yard algorithm. Operators are and, or, with in any case."""
    out: list[str] = []
    waiting: list[str] = []
    at, operand_next = 0, True
    text = expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise BadExpression(expression)
        at = m.end()
        token = m[1] or m[2]
        low = token.lower()
        if low in _BINDS:
            if operand_next:
                raise BadExpression(expression)
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next or waiting[-1:] == ["with"]:
                raise BadExpression(expression)
            waiting.append(token)
        elif token == ")":
            if operand_next:
                raise BadExpression(expression)
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise BadExpression(expression)
            waiting.pop()
        else:
            if not operand_next:
                raise BadExpression(expression)
            out.append(low)
            operand_next = False
    if operand_next:
        raise BadExpression(expression)
    while waiting:
        if (op := waiting.pop()) == "(":
            raise BadExpression(expression)
        out.append(op)
    return out


def known(identifier: str) -> bool:
    """Whether it is the identifier of a licence: a known family with versions and variants, or one of the document's own."""
    low = identifier.lower().rstrip("+")
    parts = low.split("-")
    return low.startswith(_OWN) or any(
        "-".join(parts[:n]) in _FAMILY and all(map(_VARIANT.fullmatch, parts[n:])) for n in range(1, len(parts) + 1)
    )


def terms_of(identifier: str) -> str:
    """permissive, copyleft, restricted or unknown: by the longest known family that the identifier begins with."""
    parts = identifier.rstrip("+").split("-")
    for n in range(len(parts), 0, -1):
        if kind := _FAMILY.get("-".join(parts[:n])):
            return kind
    return "unknown"


def evaluate(expression: str) -> tuple[list[str], str]:
    """The identifiers of an expression and its terms: ``or`` takes the freer side, ``and`` the stricter one, ``with``
    adds an exception to its licence, which turns copyleft into permissive."""
    names: list[str] = []
    stack: list[tuple[str, bool]] = []  # terms, and whether it is a plain identifier
    for token in postfix(expression):
        if token not in _BINDS:
            names.append(token)
            stack.append((terms_of(token), True))
            continue
        (b, plain_b), (a, plain_a) = stack.pop(), stack.pop()
        if token == "with":
            if not (plain_a and plain_b):
                raise BadExpression(expression)
            names.pop()  # the exception is no licence
            stack.append(("permissive" if a == "copyleft" else a, False))
        else:
            pick = min if token == "or" else max
            stack.append((pick(a, b, key=TERMS.index), False))
    return sorted(set(names)), stack[0][0]


def longest_expression(line: str, at: int = 0, end: int | None = None) -> tuple[str, list[str], str] | None:
    """The longest run of tokens at the start of the line (or from ``at`` to ``end``) that is an expression, in one pass.

    The pass ends at the first token that no expression can have there. A licence before ``with`` must be plain: an
    identifier, in parentheses or not.
    """
    tokens: list[str] = []
    groups: list[bool] = []  # for each open parenthesis, whether an operator stands in it
    whole, end = 0, len(line) if end is None else end
    operand_next, plain, excepted = True, False, False
    while m := _TOKEN.match(line, at, end):
        token, at = m[1] or m[2], m.end()
        low = token.lower()
        if (low in _BINDS or token == ")") == operand_next or (excepted and token == "("):
            break
        if low == "with":
            if not plain:
                break
            operand_next = excepted = True
        elif low in _BINDS:
            if groups:
                groups[-1] = True
            operand_next = True
        elif token == "(":
            groups.append(False)
        elif token == ")":
            if not groups:
                break
            plain = not groups.pop() and plain
        else:
            plain, operand_next, excepted = not excepted, False, False
        tokens.append(token)
        if not operand_next and not groups:
            whole = len(tokens)
    if not whole:
        return None
    text = " ".join(tokens[:whole]).replace("( ", "(").replace(" )", ")")
    return text, *evaluate(text)


def _phrases() -> dict[tuple[bytes, ...], tuple]:
    out: dict[tuple[bytes, ...], list] = {}
    for kind, table in (("base", BASE), ("notice", NOTICES), ("tag", {t: None for t in TAGS})):
        for phrase, value in table.items():
            out.setdefault(tuple(phrase.encode().split()), []).append((kind, value))
    return {k: tuple(v) for k, v in out.items()}


def tagged(text: bytes | None, tags: list[tuple[int, int]]) -> Iterator[tuple[str, list[str], str]]:
    """The expressions behind tags (spans of words), each within its line. The text is read once, whatever the tags."""
    if not tags:
        return
    whole, line_end = text.decode("utf-8", "replace"), -1
    for _, end in offsets(text, tags):
        if m := _AFTER.match(whole, end):
            if m.end() > line_end:
                line_end = whole.find("\n", m.end())
                line_end = len(whole) if line_end < 0 else line_end
            if found := longest_expression(whole, m.end(), line_end):
                yield found


def scan_text(text: bytes | None, automaton: WordAutomaton) -> dict:
    words = words_of(text)
    base, missing, tags = [], 1.0, []
    weights: dict[str, float] = {}
    for a, z, values in automaton.find(words):
        for kind, value in values:
            if kind == "base":
                base.append((a, value))
                weights[value] = max(weights.get(value, 0), BASE_WEIGHT[value])
            elif kind == "notice":
                weights[value[0]] = max(weights.get(value[0], 0), value[1])
            else:
                tags.append((a, z))
    expressions = []
    for found in tagged(text, tags):
        if names := [x for x in found[1] if known(x)]:
            expressions.append(found)
            weights |= dict.fromkeys(names, 0.99)
    labels = set(weights)
    for w in weights.values():
        missing *= 1 - w
    terms = {t for *_, t in expressions} or {terms_of(x) for x in labels}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min((a for a, _ in base), default=None),
        "last_word": max((a for a, _ in base), default=None),
        "base_labels": ",".join(sorted({x for _, x in base})),
        "labels": ",".join(sorted(labels)),
        "score": min(1.0, 1 - missing),
        "expressions": [x[0] for x in expressions],
        "terms": max(terms, key=TERMS.index) if terms else None,
    }


_FIELDS = [
    ("n_words", pa.int64(), "long"),
    ("n_base", pa.int64(), "long"),
    ("first_word", pa.int64(), "long"),
    ("last_word", pa.int64(), "long"),
    ("base_labels", pa.string(), "string"),
    ("labels", pa.string(), "string"),
    ("score", pa.float64(), "double"),
    ("expressions", pa.list_(pa.string()), "array<string>"),
    ("terms", pa.string(), "string"),
]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, counts and places of the base phrases, labels, score, licence expressions and their terms.

    A tag needs its colon or equals sign, and gives labels for known identifiers and LicenseRef- ones only; an expression
    without any is none. score is 1 minus the product of (1 - weight) over the labels: 0 without any, near 1 with a tag or a full notice.
    terms is the strictest among the expressions, or the labels where there is no expression. Null and empty texts
    have no words, empty label strings, score 0 and null places. Every row, repeated ones too, gives one row.
    """
    phrases = _phrases()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WordAutomaton(phrases)
        for b in batches:
            found = [scan_text(t, automaton) for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols = [pa.array([x[n] for x in found], kind) for n, kind, _ in _FIELDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *(n for n, *_ in _FIELDS)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, _, t in _FIELDS))
    return stage(out, "licences", TEXT_ROWS)
