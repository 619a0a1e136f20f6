"""License rules: no gate may drop what a rule's own pattern matches."""

import re
from re import _parser

from swathe.llm import licenses
from swathe.llm.licenses import GATE, RULES, license_scan

from . import helpers as H


def variants(tree):
    """Texts that match: the first choice everywhere, then each other choice on its own."""
    parts = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            if str(arg[0][0]) == "NEGATE" or arg[0] == (_parser.RANGE, (0, 0x2F)):
                parts.append(["x" if str(arg[0][0]) == "NEGATE" else " "])  # a word between, what parts words
                continue
            parts.append([" " if str(k) == "CATEGORY" else chr(v[0] if str(k) == "RANGE" else v) for k, v in arg])
        elif name == "SUBPATTERN":
            parts.append(variants(arg[3]))
        elif name == "BRANCH":
            parts.append([x for b in arg[1] for x in variants(b)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, _, sub = arg
            found = variants(sub)
            parts.append([x * low for x in found] + ([] if low else found))
        elif name == "ASSERT_NOT":
            parts.append([""])
        else:
            raise ValueError(name)
    first = "".join(p[0] for p in parts)
    return [first] + ["".join(p[0] for p in parts[:i]) + x + "".join(p[0] for p in parts[i + 1 :]) for i, p in enumerate(parts) for x in p[1:]]


def core(rule):
    """The rule's pattern without its word boundaries, in Python's notation."""
    head, tail = f"(?i)(?<!{licenses.WORD})", f"(?!{licenses.WORD})"
    assert rule["pattern"].startswith(head) and rule["pattern"].endswith(tail)
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", rule["pattern"][len(head) : -len(tail)])


def test_keywords_and_gate_let_every_alternative_through():
    cc_by = re.compile(r"(?<!\w)cc[^0-9a-z]+by(?!\w)")
    lost, seen = [], 0
    for rule in RULES:
        pattern = re.compile(core(rule), re.I)
        for text in map(str.lower, variants(_parser.parse(core(rule)))):
            assert pattern.fullmatch(text), (rule["pattern"], text)
            seen += 1
            if rule["keyword"] not in text or not (any(g in text for g in GATE) or cc_by.search(text)):
                lost.append((rule["keyword"], text))
    assert seen > 3 * len(RULES) and not lost


CC_NAMES = {
    "Creative Commons Attribution-Share Alike 3.0 Unported": "cc-by-sa-3.0", "Creative Commons Attribution Share-Alike 2.5": "cc-by-sa-2.5", "Creative Commons Attribution-ShareAlike": "cc-by-sa",
    "Creative Commons Attribution-Non Commercial 2.0": "cc-by-nc-2.0", "licensed under the Creative Commons Attribution-Non-Commercial 4.0": "cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial": "cc-by-nc",
    "Creative Commons Attribution-Non-Commercial-Share Alike 3.0": "cc-by-nc-sa-3.0", "Creative Commons Attribution-NoDerivs 2.0": "cc-by-nd-2.0",
    "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0": "cc-by-nc-nd-4.0", "Creative Commons Attribution 4.0": "cc-by-4.0",
}


def test_creative_commons_names_keep_their_label(spark):
    got = {r["doc_id"]: r["labels"] for r in license_scan(H.docs_frame(spark, list(enumerate(CC_NAMES)))).collect()}
    assert got == dict(enumerate(CC_NAMES.values()))


MIT = """Copyright (c) 2020 A. Nonymous

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in the Software without restriction.
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software."""
BODIES = {
    MIT: "mit",
    "THE SOFTWARE IS PROVIDED “AS IS”, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\n# IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n# FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "mit",
    "Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that": "bsd",
    "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the <organization> nor the\n names of its contributors may be used to endorse or promote products derived from this software": "bsd,bsd-3-clause,proprietary",
    "Neither the name of X nor the names of contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.": "zlib",
    "The origin of this software must not be misrepresented; you must not\nclaim that you wrote the original software.": "zlib",
    "We hereby redistribute the advertising; he is liable.": "",
}


def test_bodies_without_a_name_get_their_label(spark):
    got = {r["doc_id"]: r["labels"] for r in license_scan(H.docs_frame(spark, list(enumerate(BODIES)))).collect()}
    assert got == dict(enumerate(BODIES.values()))
