"""License scan by ordered signature rules.

A rule is a regular expression with a label, a priority, a confidence and a
keyword. Documents without any of a few literals cost that search; in the
others only the rules of the keywords they hold run. Detections are intervals of characters. One that lies
inside a detection of at least its priority (if equal, a longer one or, at the same
place, an earlier rule) is suppressed.

Column expressions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"

# Phrases whose words must stand consecutively, and their labels.
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

# Label; keyword; name; versions; SPDX stem; address.
FAMILIES = """
gpl; gnu; gnu\\s+general\\s+public\\s+licen[cs]e; 1 2 3; GPL; gnu\\.org/licenses/(?:old-licenses/)?gpl
gpl; gpl; (?:gnu\\s+)?gpl; 1 2 3; ;
lgpl; gnu; gnu\\s+(?:lesser|library)\\s+general\\s+public\\s+licen[cs]e; 2 2.1 3; LGPL; gnu\\.org/licenses/(?:old-licenses/)?lgpl
lgpl; gpl; lgpl; 2 2.1 3; ;
agpl; affero; (?:gnu\\s+)?affero\\s+general\\s+public\\s+licen[cs]e; 1 3; AGPL; gnu\\.org/licenses/agpl
agpl; gpl; agpl; 1 3; ;
fdl; gnu; gnu\\s+free\\s+documentation\\s+licen[cs]e; 1.1 1.2 1.3; GFDL; gnu\\.org/licenses/(?:old-licenses/)?fdl
apache; apache; apache(?:\\s+software)?\\s+licen[cs]e; 1.0 1.1 2.0; Apache; apache\\.org/licenses/LICENSE
mit; mit; mit\\s+licen[cs]e; ; MIT; opensource\\.org/licenses/mit
bsd; bsd; bsd\\s+licen[cs]e; ; BSD; opensource\\.org/licenses/bsd
bsd-2-clause; bsd; (?:2|two)[-\\s]clause\\s+bsd|bsd\\s+(?:2|two)[-\\s]clause|simplified\\s+bsd; ; BSD-2-Clause; opensource\\.org/licenses/bsd-2
bsd-3-clause; bsd; (?:3|three)[-\\s]clause\\s+bsd|bsd\\s+(?:3|three)[-\\s]clause|(?:new|modified)\\s+bsd; ; BSD-3-Clause; opensource\\.org/licenses/bsd-3
mpl; mozilla; mozilla\\s+public\\s+licen[cs]e; 1.0 1.1 2.0; MPL; mozilla\\.org/(?:en-US/)?MPL
epl; eclipse; eclipse\\s+public\\s+licen[cs]e; 1.0 2.0; EPL; eclipse\\.org/legal/epl
cddl; distribution; common\\s+development\\s+and\\s+distribution\\s+licen[cs]e; 1.0 1.1; CDDL; opensource\\.org/licenses/cddl
cpl; common; common\\s+public\\s+licen[cs]e; 1.0; CPL; opensource\\.org/licenses/cpl
artistic; artistic; artistic\\s+licen[cs]e; 1.0 2.0; Artistic; opensource\\.org/licenses/artistic
zlib; zlib; zlib(?:/libpng)?\\s+licen[cs]e; ; Zlib; opensource\\.org/licenses/zlib
isc; isc; isc\\s+licen[cs]e; ; ISC; opensource\\.org/licenses/isc
boost; boost; boost\\s+software\\s+licen[cs]e; 1.0; BSL; boost\\.org/LICENSE
unlicense; unlicense; (?:the\\s+)?unlicense; ; Unlicense; unlicense\\.org
wtfpl; fuck; do\\s+what\\s+the\\s+fuck\\s+you\\s+want\\s+to\\s+public\\s+licen[cs]e; 2; WTFPL; wtfpl\\.net
eupl; european; european\\s+union\\s+public\\s+licen[cs]e; 1.0 1.1 1.2; EUPL; joinup\\.ec\\.europa\\.eu
python; python; python\\s+software\\s+foundation\\s+licen[cs]e; 2; PSF; python\\.org/psf
php; php; php\\s+licen[cs]e; 3.0 3.01; PHP; php\\.net/license
postgresql; postgresql; postgresql\\s+licen[cs]e; ; PostgreSQL; opensource\\.org/licenses/postgresql
openssl; openssl; openssl\\s+licen[cs]e; ; OpenSSL; openssl\\.org/source/license
ofl; font; (?:sil\\s+)?open\\s+font\\s+licen[cs]e; 1.0 1.1; OFL; scripts\\.sil\\.org/OFL
odbl; database; open\\s+(?:data\\s+commons\\s+open\\s+)?database\\s+licen[cs]e; 1.0; ODbL; opendatacommons\\.org/licenses/odbl
odc-by; commons; open\\s+data\\s+commons\\s+attribution\\s+licen[cs]e; 1.0; ODC-By; opendatacommons\\.org/licenses/by
pddl; dedication; public\\s+domain\\s+dedication\\s+and\\s+licen[cs]e; 1.0; PDDL; opendatacommons\\.org/licenses/pddl
cc0; cc0; cc0; 1.0; CC0; creativecommons\\.org/publicdomain/zero
cc-by; cc; cc[-\\s]by; 1.0 2.0 2.5 3.0 4.0; CC-BY; creativecommons\\.org/licenses/by/
cc-by-sa; cc; cc[-\\s]by[-\\s]sa; 1.0 2.0 2.5 3.0 4.0; CC-BY-SA; creativecommons\\.org/licenses/by-sa/
cc-by-nd; cc; cc[-\\s]by[-\\s]nd; 1.0 2.0 2.5 3.0 4.0; CC-BY-ND; creativecommons\\.org/licenses/by-nd/
cc-by-nc; cc; cc[-\\s]by[-\\s]nc; 1.0 2.0 2.5 3.0 4.0; CC-BY-NC; creativecommons\\.org/licenses/by-nc/
cc-by-nc-sa; cc; cc[-\\s]by[-\\s]nc[-\\s]sa; 1.0 2.0 2.5 3.0 4.0; CC-BY-NC-SA; creativecommons\\.org/licenses/by-nc-sa/
cc-by-nc-nd; cc; cc[-\\s]by[-\\s]nc[-\\s]nd; 1.0 2.0 2.5 3.0 4.0; CC-BY-NC-ND; creativecommons\\.org/licenses/by-nc-nd/
cc-by; attribution; creative\\s+commons\\s+attribution; 1.0 2.0 2.5 3.0 4.0; ;
cc-by-sa; share; creative\\s+commons\\s+attribution[-\\s]+share[-\\s]*alike; 1.0 2.0 2.5 3.0 4.0; ;
cc-by-nd; attribution; creative\\s+commons\\s+attribution[-\\s]+no[-\\s]*deriv(?:ative)?s(?:[-\\s]+works)?; 1.0 2.0 2.5 3.0 4.0; ;
cc-by-nc; commercial; creative\\s+commons\\s+attribution[-\\s]+non[-\\s]*commercial; 1.0 2.0 2.5 3.0 4.0; ;
cc-by-nc-sa; commercial; creative\\s+commons\\s+attribution[-\\s]+non[-\\s]*commercial[-\\s]+share[-\\s]*alike; 1.0 2.0 2.5 3.0 4.0; ;
cc-by-nc-nd; commercial; creative\\s+commons\\s+attribution[-\\s]+non[-\\s]*commercial[-\\s]+no[-\\s]*deriv(?:ative)?s(?:[-\\s]+works)?; 1.0 2.0 2.5 3.0 4.0; ;
public-domain; domain; (?:in|into|to)\\s+the\\s+public\\s+domain; ; ;
proprietary; reserved; all\\s+rights\\s+reserved; ; ;
proprietary; confidential; proprietary\\s+and\\s+confidential; ; ;
"""
# Label; keyword; a sentence of the licence's own wording. Words may be parted by whatever isn't a letter or a digit. In a sentence, ? begins words
# that may be missing (joined by _), | parts alternatives and ... stands for up to 15 words. Apache 1.1, OpenSSL and PHP repeat those of bsd.
SIGNATURES = """
mit; hereby; permission is hereby granted free of charge to any person obtaining a copy of this software and ?to_any associated documentation files
mit; substantial; the above copyright notice and this permission notice ?including_the_next_paragraph shall be included in all copies or substantial portions of the software
mit; noninfringement; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
bsd; redistribution; redistribution and use in source and binary forms with or without modification are permitted
bsd; redistributions; redistributions of source code must retain the ?above copyright notice this list of conditions and the following disclaimer
bsd; redistributions; redistributions in binary form must reproduce the ?above copyright notice this list of conditions and the following disclaimer in the documentation
bsd; merchantability; this software is provided by ... as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
bsd-3-clause; endorse; neither the name|names of ... nor the names of ?its|his|her|their contributors may be used to endorse or promote products derived from this software
bsd-4-clause; advertising; all advertising materials mentioning features or use of this software must display the following acknowledgement|acknowledgment
isc; hereby; permission to use copy modify and ?or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
postgresql; hereby; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
zlib; liable; this software is provided as is without any express or implied warranty in no event will|shall the author|authors be held liable for any damages arising from the use of this software
zlib; redistribute; permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib; misrepresented; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; misrepresented; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1.0; hereby; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost-1.0; infringement; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement
apache-2.0; irrevocable; subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
apache-2.0; applicable; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
gpl-2.0; gnu; under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-3.0; gnu; under the terms of the gnu general public license as published by the free software foundation either version 3
lgpl-2.1; gnu; under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3.0; gnu; under the terms of the gnu lesser general public license as published by the free software foundation either version 3
agpl-3.0; affero; under the terms of the gnu affero general public license as published by the free software foundation either version 3
unlicense; unencumbered; this is free and unencumbered software released into the public domain
unlicense; compile; anyone is free to copy modify publish use compile sell or distribute this software
wtfpl; fuck; you just do what the fuck you want to
ofl; hereby; permission is hereby granted free of charge to any person obtaining a copy of the font software
cc0-1.0; affirmer; affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
"""
# Every rule's match, and every base phrase, holds one of these, or the words "cc" and "by" in a row.
GATE = (
    "licen spdx gpl bsd cc0 commons domain reserved proprietary wtfpl mozilla.org/ eclipse.org/ joinup. python.org/psf sil.org/ "
    "hereby substantial infringement redistribut merchantability endorse advertising liable misrepresented compile fuck affirmer"
).split()
GRANT = "(?:licen[cs]ed|released|distributed|available|published)\\s+under\\s+(?:the\\s+)?(?:terms\\s+of\\s+the\\s+)?"
# What parts the words of a sentence, with typographic quotes and dashes, and a word between.
MARKED = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F\\x{A0}\\x{2010}-\\x{201F}\\x{2022}"
PARTED, OTHER = f"[{MARKED}]++", f"[^{MARKED}]++"
c = F.col


def rules() -> list[dict]:
    """The ordered rules: for each family its SPDX tags, addresses, versions, grants and bare names, then sentences of the licences themselves."""
    out = []

    def add(label: str, keyword: str, priority: int, confidence: float, pattern: str) -> None:
        out.append({"rule": len(out), "label": label, "keyword": keyword, "priority": priority, "confidence": confidence, "pattern": f"(?i)(?<!{WORD})(?:{pattern})(?!{WORD})"})

    for line in FAMILIES.strip().split("\n"):
        label, keyword, name, versions, spdx, address = (x.strip() for x in line.split(";"))
        name = f"(?:{name})"
        for v in versions.split():
            short, number = v.removesuffix(".0"), v if "." in v else f"{v}.0"
            digits = re_number(v)
            version = f"[,\\s]+(?:version\\s+|v\\.?\\s*)?{digits}"
            if spdx:
                add(f"{label}-{number}", "spdx", 5, 1.0, f"spdx-license-identifier:\\s*{spdx}-{re_number(number)}(?:-only|-or-later|\\+)?")
            add(f"{label}-{number}", keyword, 4, 0.95, f"{GRANT}{name}{version}")
            add(f"{label}-{number}", keyword, 3, 0.85, f"{name}{version}")
            if address:
                add(f"{label}-{number}", keyword if keyword in address.lower() else "http", 4, 0.9, f"https?://(?:www\\.)?{address}[-/]?{short.replace('.', '\\.')}(?:\\.0)?")
        if spdx:
            add(label, "spdx", 5, 1.0, f"spdx-license-identifier:\\s*{spdx}(?:-only|-or-later|\\+)?")
        if address:
            add(label, "http", 3, 0.8, f"https?://(?:www\\.)?{address}")
        add(label, keyword, 2, 0.75, f"{GRANT}{name}")
        add(label, keyword, 1, 0.6, name)
    for line in SIGNATURES.strip().split("\n"):
        label, keyword, sentence = (x.strip() for x in line.split(";"))
        add(label, keyword, 4, 0.9, _sentence(sentence))
    return out


def _sentence(words: str) -> str:
    """Pattern of a signature's sentence."""
    out = ""
    for word in words.split():
        may = word.startswith("?")
        inner = PARTED.join(word.removeprefix("?").split("_")) if "|" not in word else f"(?:{word.removeprefix('?')})"
        after = PARTED if out else ""
        out += f"(?:{PARTED}{OTHER}){{1,15}}?" if word == "..." else f"(?:{after}{inner})?" if may else f"{after}{inner}"
    return out


def re_number(v: str) -> str:
    """A version's digits; a last .0 may be left out."""
    whole, _, part = v.partition(".")
    return f"{whole}(?:\\.0)?" if part in ("", "0") else f"{whole}\\.{part}"


RULES = rules()
KEYWORDS = sorted({r["keyword"] for r in RULES})


def _literal(rows: list[dict]):
    return F.array(*[F.struct(*[F.lit(r[k]).alias(k) for k in ("rule", "label", "keyword", "priority", "confidence", "pattern")]) for r in rows])


def _phrase(words: str) -> str:
    return f"(?i)(?<!{WORD})" + f"{GAP}+".join(words.split()) + f"(?!{WORD})"


def _words_before(start):
    return F.regexp_count(F.substring(c("text"), F.lit(1), start), F.lit(f"{WORD}+")).cast("long")


def detections(docs: DataFrame) -> DataFrame:
    """Detections that aren't suppressed: key, label, confidence, priority, start and end (characters from 0). ``docs``: key, text."""
    # One-element arrays bind what lambdas use again and again, which is then evaluated once per text.
    held = lambda low: F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(low, k))
    usable = lambda h: F.filter(_literal(RULES), lambda r: F.array_contains(h, r["keyword"]))
    chosen = docs.select("key", "text", F.transform(F.transform(F.array(F.lower("text")), held), usable)[0].alias("chosen"))
    hit = chosen.select("key", "text", F.explode(F.filter("chosen", lambda r: F.regexp_like("text", r["pattern"]))).alias("r"))
    pieces = hit.select("key", "r", F.expr("regexp_extract_all(text, r.pattern, 0)").alias("found"), F.expr("split(text, r.pattern, -1)").alias("gaps"))
    each = pieces.select("key", "r", F.posexplode(F.arrays_zip(F.transform("found", F.char_length).alias("size"), F.transform("gaps", F.char_length).alias("gap"))).alias("n", "at")).where("at.size is not null")
    before = Window.partitionBy("key", "r.rule").orderBy("n")
    placed = each.select("key", "r.*", (F.sum(c("at.gap") + c("at.size")).over(before)).alias("end"), c("at.size").alias("size")).withColumn("start", c("end") - c("size"))
    # Sorted so that whatever may hold a detection stands before it; one running maximum per priority.
    w = Window.partitionBy("key").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r["priority"] for r in RULES})
    reach = [F.max(F.when(c("priority") == p, c("end"))).over(w).alias(f"reach_{p}") for p in levels]
    inside = F.greatest(*[F.when(c("priority") <= p, F.coalesce(f"reach_{p}", F.lit(-1))).otherwise(-1) for p in levels]) >= c("end")
    # The same place with a higher priority also stands before; a wider one of lower priority never hides a detection.
    return placed.select("*", *reach).where(~inside).select("key", "label", "confidence", "priority", "start", "end")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are counted on the text with A-Z in lower case. ``n_base`` counts
    the places where a base phrase's words stand consecutively, ``first_word`` and
    ``last_word`` are their smallest and largest first words, from 0 (null without any).
    ``labels`` joins the base labels and those of detections that aren't
    suppressed; ``score`` is the largest confidence (a base place: 0.7; none: 0).
    Null texts are empty; null doc_ids and repeated rows are scanned like any other.
    """
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", text.alias("text"))
    n_words = F.regexp_count("text", F.lit(f"{WORD}+")).cast("long").alias("n_words")
    low = F.lower("text")
    gate = F.contains(low, F.lit("cc")) & c("text").rlike(_phrase("cc by"))
    for literal in GATE:
        gate = F.contains(low, F.lit(literal)) | gate
    rows = cut(counted.where(gate).select("doc_id", "text", n_words, F.monotonically_increasing_id().alias("key")), "licensed")
    kept = detections(rows).groupBy("key").agg(F.collect_set("label").alias("own"), F.max("confidence").alias("best"))
    n = {label: F.regexp_count("text", F.lit(_phrase(p))) for label, p in BASE.items()}
    first = F.least(*[F.nullif(F.regexp_instr("text", F.lit(_phrase(p))), F.lit(0)) for p in BASE.values()]) - 1
    last = F.greatest(*[F.when(c(f"n_{i}") > 0, F.char_length(F.regexp_extract("text", "(?s)^(.*)" + _phrase(p), 1))) for i, p in enumerate(BASE.values())])
    base = rows.select("*", *[n[x].alias(f"n_{i}") for i, x in enumerate(BASE)])
    total = sum((c(f"n_{i}") for i in range(1, len(BASE))), c("n_0"))
    base = base.withColumn("n_base", total.cast("long"))
    labels = F.array_sort(F.filter(F.array(*[F.when(c(f"n_{i}") > 0, F.lit(x)) for i, x in enumerate(BASE)]), lambda x: x.isNotNull()))
    placed = base.select(
        "doc_id", "key", "n_words", "n_base", labels.alias("base"),
        F.when(c("n_base") > 0, _words_before(first)).alias("first_word"), F.when(c("n_base") > 0, _words_before(last)).alias("last_word"),
    )
    joined = placed.join(kept, "key", "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(c("n_base") > 0, 0.7).otherwise(0.0))
    scanned = joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"), score.alias("score"))
    none, nothing = F.lit(None).cast("long"), F.lit("")
    rest = counted.where(~gate).select("doc_id", n_words, F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"), nothing.alias("base_labels"), nothing.alias("labels"), F.lit(0.0).alias("score"))
    return scanned.unionByName(rest)
