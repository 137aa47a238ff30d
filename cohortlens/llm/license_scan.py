"""License scan: ordered signature rules behind a keyword prefilter, in DataFrame functions only.

Texts are normalised to lower-case words joined by single spaces.  A text that holds none of the rules' keywords is
done.  For the others, each keyword found brings the rules that need it, each rule's regular expression gives its
matches, and the words between the matches give their places.

Detections of one text are ordered by start, longest first, then priority.  One that lies inside an earlier one is
suppressed (of equal intervals, the first priority stays).  The rest are taken by priority, then start: one stays unless
it overlaps one that already stays, so a detection that is itself suppressed suppresses nothing.  Base phrases are
reported at all their places, whatever is suppressed.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, keyword, pattern of the name, versions ("" stands for no version).
FAMILIES = [
    ("apache", "apache", r"apache(?: software)? licen[sc]e", ("1.0", "1.1", "2.0", "")),
    ("gpl", "gnu", r"gnu general public licen[sc]e", ("1", "2", "3", "")),
    ("lgpl", "gnu", r"gnu (?:lesser|library) general public licen[sc]e", ("2", "2.1", "3", "")),
    ("agpl", "gnu", r"gnu affero general public licen[sc]e", ("1", "3", "")),
    ("gfdl", "gnu", r"gnu free documentation licen[sc]e", ("1.1", "1.2", "1.3", "")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2.1", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3")),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1.0", "1.1", "2.0", "")),
    ("epl", "eclipse", r"eclipse public licen[sc]e", ("1.0", "2.0", "")),
    ("cddl", "common development", r"common development and distribution licen[sc]e", ("1.0", "1.1", "")),
    ("cpl", "common public", r"common public licen[sc]e", ("1.0", "")),
    ("eupl", "european union", r"european union public licen[sc]e", ("1.0", "1.1", "1.2", "")),
    ("osl", "open software", r"open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0", "")),
    ("afl", "academic free", r"academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0", "")),
    ("artistic", "artistic", r"artistic licen[sc]e", ("1.0", "2.0", "")),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", ("1.0", "1.1", "")),
    ("lppl", "latex", r"latex project public licen[sc]e", ("1.0", "1.1", "1.2", "1.3", "")),
    ("cecill", "cecill", r"cecill(?: licen[sc]e)?", ("1.0", "1.1", "2.0", "2.1", "")),
    ("odbl", "open database", r"open database licen[sc]e", ("1.0", "")),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", ("1.0", "")),
    ("bsl", "boost", r"boost software licen[sc]e", ("1.0", "")),
    ("busl", "business source", r"business source licen[sc]e", ("1.0", "1.1", "")),
    ("sspl", "server side public", r"server side public licen[sc]e", ("1", "")),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", ("1.0", "")),
    ("zpl", "zope", r"zope public licen[sc]e", ("1.1", "2.0", "2.1", "")),
    ("php", "php licen", r"php licen[sc]e", ("3.0", "3.01", "")),
    ("python", "python", r"python(?: software foundation)? licen[sc]e", ("2", "")),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", ("",)),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", ("",)),
    ("mit", "mit licen", r"(?:the )?mit licen[sc]e", ("",)),
    ("isc", "isc licen", r"(?:the )?isc licen[sc]e", ("",)),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e", ("",)),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd licen[sc]e)(?: licen[sc]e)?", ("",)),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|(?:3|three) clause bsd|new bsd|modified bsd)(?: licen[sc]e)?", ("",)),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", ("",)),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ("",)),
    ("wtfpl", "wtfpl", r"wtfpl", ("2", "")),
    ("beerware", "beerware", r"beerware(?: licen[sc]e)?", ("",)),
    ("json", "json licen", r"json licen[sc]e", ("",)),
    ("openssl", "openssl", r"openssl licen[sc]e", ("",)),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", ("",)),
    ("proprietary", "proprietary", r"proprietary(?: and confidential| licen[sc]e)", ("",)),
    ("no-derivatives", "derivative", r"no derivative works?", ("",)),
    ("non-commercial", "commercial", r"(?:for )?non commercial use only", ("",)),
]
GRANTS = [  # words that introduce a license; they make the detection longer and surer
    r"licensed under(?: the| an?)?(?: terms of)?(?: the)?",
    r"(?:released|distributed|available|published) under(?: the| an?)?(?: terms of)?(?: the)?",
]

# SPDX identifiers of licenses without a version.
SPDX_PLAIN = ["0bsd", "beerware", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "curl", "ftl", "hpnd", "icu", "ijg", "isc", "json",
              "libpng", "mit", "mit-0", "ms-pl", "ms-rl", "ncsa", "openssl", "postgresql", "ruby", "sleepycat", "tcl", "unlicense",
              "vim", "wtfpl", "x11", "zlib"]

ANY = r"(?: \S+){1,12}?"  # words that a notice leaves open, such as a holder's name

# Keyword, sentence of the license's text or notice, label, priority, confidence.
NOTICES = [
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", "mit", 30, 0.95),
    ("permission notice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included"
                          r" in all copies or substantial portions", "mit", 30, 0.95),
    ("permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "bsl-1.0", 30, 0.95),
    ("with or without fee", r"permission to use copy modify and(?: or)? distribute this software(?: and its documentation)? for any purpose"
                            r" with or without fee is hereby granted", "isc", 30, 0.95),
    ("source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted", "bsd", 30, 0.9),
    ("endorse or promote", rf"neither the names? of{ANY} may be used to endorse or promote products", "bsd-3-clause", 25, 0.95),
    ("endorse or promote", rf"the names? of{ANY} may not be used to endorse or promote products", "bsd-3-clause", 28, 0.9),
    ("advertising materials", r"all advertising materials mentioning features or use of this software must display", "bsd-4-clause", 25, 0.95),
    ("altered source versions", r"altered source versions must be plainly marked as such", "zlib", 30, 0.95),
    ("origin of this software", r"the origin of this software must not be misrepresented", "zlib", 30, 0.95),
    ("free and unencumbered", r"this is free and unencumbered software released into the public domain", "unlicense", 20, 1.0),
    ("compliance with the license", r"you may not use this file except in compliance with the license", "apache-2.0", 30, 0.9),
    ("applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license"
                       r" is distributed on an as is basis", "apache-2.0", 30, 0.95),
    ("perpetual worldwide", r"grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", "apache-2.0", 35, 0.8),
    ("gnu general", r"under the terms of(?: version \d of)? the gnu general public licen[sc]e as published by the free software foundation", "gpl", 25, 0.95),
    ("gnu general", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation"
                    r" (?:either )?version 2(?: of the licen[sc]e)?", "gpl-2", 15, 1.0),
    ("gnu general", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation"
                    r" (?:either )?version 3(?: of the licen[sc]e)?", "gpl-3", 15, 1.0),
    ("gnu lesser", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation"
                   r" (?:either )?version 2 1(?: of the licen[sc]e)?", "lgpl-2.1", 15, 1.0),
    ("gnu lesser", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation"
                   r" (?:either )?version 3(?: of the licen[sc]e)?", "lgpl-3", 15, 1.0),
    ("gnu affero", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation"
                   r" (?:either )?version 3(?: of the licen[sc]e)?", "agpl-3", 15, 1.0),
    ("free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation"
                           r" licen[sc]e", "gfdl", 20, 1.0),
    ("source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", "mpl-2.0", 15, 1.0),
    ("mozilla public", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", "mpl-1.1", 15, 1.0),
    ("eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"
                       r"(?: v1 0| v 1 0)", "epl-1.0", 15, 1.0),
    ("eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"
                       r"(?: v2 0| v 2 0| 2 0)", "epl-2.0", 15, 1.0),
    ("common development", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "cddl", 20, 1.0),
    ("font software", r"this font software is licensed under the sil open font licen[sc]e version 1 1", "ofl-1.1", 15, 1.0),
    ("what the fuck", r"do what the fuck you want to public licen[sc]e", "wtfpl", 30, 1.0),
    ("verbatim or modified", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document", "wtfpl", 30, 0.9),
    ("buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer", "beerware", 20, 1.0),
    ("waived all copyright", rf"to the extent possible under law{ANY} waived all copyright and related or neighbou?ring rights", "cc0", 20, 1.0),
    ("creative commons", r"this work is licensed under(?: a| the)? creative commons licen[sc]e", "cc", 45, 0.8),
    ("used for good", r"the software shall be used for good not evil", "json", 20, 1.0),
    ("warranty of any kind", r"the software is provided as is without warranty of any kind express or implied", "as-is", 70, 0.5),
    ("strictly prohibited", r"unauthorized (?:copying|use|reproduction|distribution)(?: \S+){0,12}? (?:is )?strictly prohibited", "proprietary", 30, 0.95),
    ("confidential and proprietary", r"confidential and proprietary(?: information)?(?: of)?", "proprietary", 50, 0.8),
    ("written permission", r"(?:without|except with)(?: the)?(?: express)?(?: prior)?(?: express)? written permission", "proprietary", 65, 0.5),
    ("internal use only", r"for internal use only", "proprietary", 50, 0.8),
    ("derechos reservados", r"todos los derechos reservados", "reserved", 85, 0.5),
    ("rechte vorbehalten", r"alle rechte vorbehalten", "reserved", 85, 0.5),
    ("tous droits", r"tous droits réservés", "reserved", 85, 0.5),
]


def _words(text: str) -> str:
    return text.replace(".", " ").replace("-", " ")


def _rules() -> list[tuple[str, str, str, int, float, bool]]:
    """(keyword, pattern, label, priority, confidence, base); a lower priority number goes first."""
    version = r"(?: or)?(?: version| ver| v)? v?"
    rules = []
    for family, keyword, name, versions in FAMILIES:
        for number in versions:
            label = f"{family}-{number}" if number else family
            short = _words(number[:-2]) if number.endswith(".0") else None
            numbers = rf"(?:{_words(number)}{rf'|{short}(?! \d)' if short else ''})"
            tail = version + numbers + r"(?: or(?: \w+ \w+)? later(?: version)?| only)?" if number else ""
            rules.append((keyword, name + tail, label, 40 if number else 60, 0.9 if number else 0.7, False))
            for grant in GRANTS:
                rules.append((keyword, f"{grant} {name}{tail}", label, 20 if number else 30, 1.0, False))
            if number:
                rules.append(("spdx", rf"spdx license identifier {_words(family)} {_words(number)}(?: or later| only)?",
                              label, 10, 1.0, False))
    for terms, number in product(("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0", "")):
        label = f"cc-{terms}-{number}" if number else f"cc-{terms}"
        tail = f" {_words(number)}" if number else ""
        spelled = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?"}
        long = " ".join(spelled[t] for t in terms.split("-"))
        rules.append((" cc ", f"cc {_words(terms)}{tail}", label, 40 if number else 60, 0.9 if number else 0.7, False))
        rules.append((" cc ", f"{GRANTS[0]} cc {_words(terms)}{tail}", label, 20 if number else 30, 1.0, False))
        rules.append(("creative commons", f"creative commons {long}{tail}", label, 40 if number else 60, 0.9, False))
        rules.append(("creativecommons", f"creativecommons org licenses {_words(terms)}{tail}", label, 35, 1.0, False))
    for name in SPDX_PLAIN:
        rules.append(("spdx", f"spdx license identifier {_words(name)}", name, 10, 1.0, False))
    rules += [(*notice, False) for notice in NOTICES]
    rules.append(("cc0", r"cc0(?: 1 0)?", "cc0", 40, 0.9, False))
    rules.append(("creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?", "cc0", 35, 1.0, False))
    rules.append(("copyright", r"copyright(?: c)?(?: \d{4})+", "copyright", 80, 0.4, False))
    for phrase, label in BASE.items():
        rules.append((f" {phrase} ", phrase, label, 90, 0.5, True))
    return rules


RULES = _rules()
KEYWORDS = sorted({r[0] for r in RULES})


def normalised(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in lower case, with a space before, between and after; one
    space without words.  ``lower`` also lowers other letters, which are word characters either way and stand in no
    rule."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORDS, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(found: DataFrame) -> DataFrame:
    """Places of all matches: row, label, priority, confidence, base, start, end (words from 0).  ``found``: row,
    padded (texts with a keyword)."""
    spark = found.sparkSession
    rules = spark.createDataFrame(
        [(k, f"(?<= ){p}(?= )", label, priority, confidence, base, i)
         for i, (k, p, label, priority, confidence, base) in enumerate(RULES)],
        "keyword string, pattern string, label string, priority int, confidence double, base boolean, rule int")
    keywords = F.array(*[F.lit(k) for k in KEYWORDS])
    hinted = found.select("row", "padded", F.explode(F.filter(keywords, lambda k: F.contains("padded", k))).alias("keyword"))
    # The rule table is fixed.
    tried = (hinted.join(F.broadcast(rules), "keyword")
             .withColumn("matches", F.expr("regexp_extract_all(padded, pattern, 0)")).filter("size(matches) > 0")
             .withColumn("gaps", F.expr("split(padded, pattern, -1)")))
    each = tried.select("row", "label", "priority", "confidence", "base", "rule",
                        F.posexplode(F.arrays_zip("matches", F.slice("gaps", 1, F.size("matches")).alias("gaps"))).alias("nth", "m"))
    counted = each.select("*", spaces(F.col("m.matches")).alias("inside"), spaces(F.col("m.gaps")).alias("outside")).drop("m")
    upto = Window.partitionBy("row", "rule").orderBy("nth")
    start = F.sum("outside").over(upto) + F.sum("inside").over(upto) - F.col("inside") - 1
    return counted.withColumn("start", start).withColumn("end", F.col("start") + F.col("inside") + 1).drop("nth", "inside", "outside")


def surviving(found: DataFrame) -> DataFrame:
    """Detections that are not suppressed.

    What is left by containment falls into runs of detections that overlap one after the other; priorities are settled in
    each run by itself, so an array is as long as a run and not as long as a text's list of detections."""
    order = [F.col("start"), F.desc("end"), F.col("priority"), F.col("rule")]
    by_row = Window.partitionBy("row").orderBy(*order)
    inside = F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("end")
    outer = found.withColumn("inside", F.coalesce(inside, F.lit(False))).filter("not inside").drop("inside")
    opens = F.coalesce((F.lag("end").over(by_row) <= F.col("start")).cast("int"), F.lit(0))  # ends rise with the starts here
    runs = outer.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by_row))
    one = F.struct("priority", "start", "rule", "end", "label", "confidence", "base")
    ranked = runs.groupBy("row", "run").agg(F.array_sort(F.collect_list(one)).alias("ranked"))

    def settle(stay: Column, d: Column) -> Column:
        beaten = F.exists(stay, lambda k: (k["start"] < d["end"]) & (d["start"] < k["end"]))
        return F.when(beaten, stay).otherwise(F.concat(stay, F.array(d)))

    alone = F.size("ranked") == 1
    stay = F.when(alone, F.col("ranked")).otherwise(F.aggregate("ranked", F.slice("ranked", 1, 0), settle))
    return ranked.select("row", F.inline(stay))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of every row of
    ``docs`` (doc_id, text).

    A null text is empty: no words, no labels (empty strings), score 0.  Repeated rows are scanned one by one.  The
    score is the highest confidence among what is left after suppression, or of a base phrase.
    """
    padded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("padded"))
    hinted = F.lit(False)
    for keyword in KEYWORDS:
        hinted = hinted | F.contains("padded", F.lit(keyword))
    scanned = written(padded.select(
        "doc_id", F.when(F.col("padded") == "  ", 0).otherwise(spaces(F.col("padded")) - 1).cast("long").alias("n_words"),
        F.when(hinted, F.col("padded")).alias("padded")).withColumn("row", F.monotonically_increasing_id()), "scanned")
    places = written(detections(scanned.filter("padded is not null").select("row", "padded")), "places")
    base = places.filter("base").groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("base_labels"))
    left = surviving(places).select("row", "label", "confidence", F.lit(1).alias("kept"))
    always = places.filter("base").select("row", "label", "confidence", F.lit(0).alias("kept"))
    labels = left.union(always).groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("confidence").alias("score"),
        F.sum("kept").cast("long").alias("n_detections"))
    none = F.lit("")
    return (scanned.select("row", "doc_id", "n_words").join(base, "row", "left").join(labels, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_detections", F.lit(0)).alias("n_detections")))
