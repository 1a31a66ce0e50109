"""License scan: ordered signature rules over word-normalised texts (native).

A text is reduced to lower-case words separated by single spaces. A cheap keyword scan finds which of
the rules' keywords occur at all; only rules of those keywords run their regular expression, inside
the same row (higher-order functions over a constant rule array), so that nothing is shuffled and no
document is compared with another. Each match is a detection (label, first word, last word,
priority). A detection whose interval lies inside that of a detection of higher priority, or of the
same priority and greater length or earlier rule, is suppressed. Base phrases always keep their label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii

#: Items that are walked at a time.
RUN = 256

#: Phrases of the contract and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Hand-written license names: label, keyword that must occur, pattern of the name over words.
NAMES = [
    ("gpl", "gnu", r"gnu general public licen[cs]e"),
    ("gpl", "gpl", r"gpl"),
    ("gpl-2.0", "gpl", r"gpl v?2(?: 0)?(?: only)?"),
    ("gpl-2.0-or-later", "gpl", r"gpl v?2(?: 0)? or later"),
    ("gpl-3.0", "gpl", r"gpl v?3(?: 0)?(?: only)?"),
    ("gpl-3.0-or-later", "gpl", r"gpl v?3(?: 0)? or later"),
    ("gpl-2.0", "gnu", r"gnu general public licen[cs]e (?:version |v )?v?2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu general public licen[cs]e (?:version |v )?v?3(?: 0)?"),
    ("lgpl", "lesser", r"gnu lesser general public licen[cs]e"),
    ("lgpl", "library", r"gnu library general public licen[cs]e"),
    ("lgpl", "lgpl", r"lgpl(?: v?[23](?: [01])?)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e(?: (?:version )?v?3(?: 0)?)?"),
    ("agpl", "agpl", r"agpl(?: v?3(?: 0)?)?"),
    ("gfdl", "gnu", r"gnu free documentation licen[cs]e(?: (?:version )?1 [1-3])?"),
    ("gfdl", "gfdl", r"gfdl"),
    ("apache", "apache", r"apache licen[cs]e"),
    ("apache-2.0", "apache", r"apache licen[cs]e (?:version )?v?2(?: 0)?"),
    ("apache-2.0", "apache", r"apache (?:version )?v?2 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version )?v?1 1"),
    ("apache-1.0", "apache", r"apache (?:software )?licen[cs]e (?:version )?v?1 0"),
    ("apache", "apache", r"apache software licen[cs]e"),
    ("mit", "mit", r"mit licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("bsd", "bsd", r"bsd licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|old bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?"),
    ("0bsd", "0bsd", r"0bsd"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v )?v?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v )?v?2(?: 0)?"),
    ("mpl", "mpl", r"mpl (?:v?1 [01]|v?2 0)"),
    ("epl", "eclipse", r"eclipse public licen[cs]e(?: (?:version |v )?v?[12](?: 0)?)?"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e(?: (?:version |v )?v?1(?: 0)?)?"),
    ("cddl", "cddl", r"cddl(?: v?1 [01])?"),
    ("cddl", "distribution", r"common development and distribution licen[cs]e"),
    ("cpl", "common", r"common public licen[cs]e"),
    ("eupl", "eupl", r"eupl(?: v?1 [0-2])?"),
    ("eupl", "european", r"european union public licen[cs]e(?: (?:version |v )?v?1 [0-2])?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:version |v )?2(?: 0)?"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: (?:version )?1 0)?"),
    ("zlib", "zlib", r"zlib licen[cs]e"),
    ("libpng", "libpng", r"libpng licen[cs]e"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("psf", "python", r"python software foundation licen[cs]e(?: (?:version )?2)?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("php", "php", r"php licen[cs]e(?: (?:version )?3 0[01]?)?"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: 1 1)?"),
    ("ofl-1.1", "sil", r"sil open font licen[cs]e(?: (?:version )?1 1)?"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e(?: (?:version )?2 0)?"),
    ("afl-3.0", "academic", r"academic free licen[cs]e(?: (?:version |v )?3 0)?"),
    ("osl-3.0", "open", r"open software licen[cs]e(?: (?:version |v )?3 0)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("mulan-psl-2.0", "mulan", r"mulan permissive software licen[cs]e(?: (?:version |v )?v?2)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("upl-1.0", "universal", r"universal permissive licen[cs]e(?: (?:version |v )?1 0)?"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("odbl", "odbl", r"odbl(?: v?1 0)?"),
    ("odbl", "database", r"open (?:data commons open )?database licen[cs]e(?: v?1 0)?"),
    ("pddl", "pddl", r"pddl"),
    ("odc-by", "odc", r"odc by(?: 1 0)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", "domain", r"public domain dedication"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative|ativ|s)\w*(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv\w*(?: [1-4] [05])?"),
    ("proprietary", "rights", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("gpl", "gplv1", r"gplv1"),
    ("gpl-2.0", "gplv2", r"gplv2(?: 0)?(?: only)?"),
    ("gpl-3.0", "gplv3", r"gplv3(?: 0)?(?: only)?"),
    ("gpl-2.0-or-later", "gplv2", r"gplv2(?: 0)? or (?:later|newer)"),
    ("gpl-3.0-or-later", "gplv3", r"gplv3(?: 0)? or (?:later|newer)"),
    ("gpl-2.0", "gpl2", r"gpl2"),
    ("gpl-3.0", "gpl3", r"gpl3"),
    ("lgpl-2.0", "lgplv2", r"lgplv2(?: 0)?"),
    ("lgpl-2.1", "lgplv2", r"lgplv2 1"),
    ("lgpl-3.0", "lgplv3", r"lgplv3(?: 0)?"),
    ("agpl-3.0", "agplv3", r"agplv3(?: 0)?"),
    ("mpl-2.0", "mplv2", r"mplv2(?: 0)?"),
    ("epl-1.0", "eplv1", r"eplv1(?: 0)?"),
    ("epl-2.0", "eplv2", r"eplv2(?: 0)?"),
    ("apache-2.0", "asl", r"asl 2 0"),
    ("apache-2.0", "apachev2", r"apachev2(?: 0)?"),
    ("eupl-1.2", "eupl", r"euplv1 2|eupl v1 2"),
]

#: Bare SPDX identifiers; each gives one rule, behind "SPDX-License-Identifier:". The label is the identifier.
SPDX = """
    0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0
    Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0 BUSL-1.1 bzip2-1.0.6
    CAL-1.0 CATOSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5
    CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-1.0 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CNRI-Python CPAL-1.0 CPL-1.0 curl
    ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUDatagrid EUPL-1.0 EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later
    GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG Intel IPA IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later
    LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng LPL-1.02 LPPL-1.3c MirOS MIT MIT-0 MIT-Modern-Variant Motosoto MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-1.0 MulanPSL-2.0 Multics NASA-1.3 NCSA NGPL NPL-1.1
    NTP OCLC-2.0 ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OGL-UK-3.0 OLDAP-2.8 OpenSSL OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.1 RPL-1.5 RPSL-1.0 RSCPL Ruby
    SGI-B-2.0 SISSL Sleepycat SMLNJ SPL-1.0 SSPL-1.0 TCL Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim VSL-1.0 W3C Watcom-1.0 WTFPL X11 Xnet Zend-2.0 Zlib ZPL-2.0 ZPL-2.1
""".split()

#: Signatures of license texts: label, keyword, pattern over words.
_GNU = r"gnu {}general public licen[cs]e as published by the free software foundation either version {} of the licen[cs]e or at your option any later version"
BODIES = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("ncsa", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software"),
    ("bsl-1.0", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", "hereby", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("upl-1.0", "hereby", r"permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|the|their|other) (?:[^ ]+ )?contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "unless", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache", "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("gpl", "gnu", r"redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "gnu", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "gnu", r"redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl-2.0-or-later", "gnu", _GNU.format("", "2")),
    ("gpl-3.0-or-later", "gnu", _GNU.format("", "3")),
    ("lgpl-2.0-or-later", "gnu", _GNU.format("(?:library|lesser) ", "2")),
    ("lgpl-2.1-or-later", "gnu", _GNU.format("lesser ", "2 1")),
    ("lgpl-3.0-or-later", "gnu", _GNU.format("lesser ", "3")),
    ("agpl-3.0-or-later", "gnu", _GNU.format("affero ", "3")),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("epl", "eclipse", r"made available under the terms of the eclipse public licen[cs]e"),
    ("zlib", "authors", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"do what the fuck you want to"),
    ("cc0", "waived", r"waived all copyright and related or neighboring rights"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font licen[cs]e"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("public-domain", "domain", r"(?:dedicated|placed|released) (?:in ?)?to the public domain"),
    ("public-domain", "domain", r"placed in the public domain"),
]

#: How a name may be wrapped: prefix, suffix, priority added. Every name gives one rule each.
FORMS = [
    (r"", r"", 1),
    (r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?", r"", 2),
    (r"spdx licen[cs]e identifier ", r"", 3),
]


def rules() -> list[tuple[int, str, str, str, int]]:
    """(rank, label, keyword, pattern, priority) of every rule: names by forms, SPDX identifiers, texts; in fixed order."""
    made = [(label, word, f"(?<= )(?:{before}(?:{name}){after})(?= )", p) for before, after, p in FORMS for label, word, name in NAMES]
    made += [(x.lower(), "spdx", f"(?<= )(?:spdx licen[cs]e identifier {' '.join(x.lower().replace('-', '.').split('.'))})(?= )", 3) for x in SPDX]
    made += [(label, word, f"(?<= )(?:{body})(?= )", 2) for label, word, body in BODIES]
    return [(i, *r) for i, r in enumerate(made)]


def _rows(values: list[tuple], names: list[str]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in values])


def _walk(items: Column, start: dict[str, Column], step, made: str) -> Column:
    """What ``step(state, item)`` appends over all items, where it returns the next state and an array of type ``made``.

    An array that grows is copied at every append, so items are walked ``RUN`` at a time and the runs'
    results joined at the end: work is in proportion to the items, however many a long text has.
    """
    none = F.array().cast(f"array<{made}>")

    def inner(state, run):
        def one(a, x):
            new, out = step(a, x)
            return F.struct(*[c.alias(n) for n, c in new.items()], F.concat(a["_out"], out).alias("_out"))

        return F.aggregate(run, F.struct(*[state[n].alias(n) for n in start], none.alias("_out")), one)

    def runs(all_):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda i: F.slice(all_, i * RUN + 1, RUN))
        first = F.struct(*[c.alias(n) for n, c in start.items()], F.array().cast(f"array<array<{made}>>").alias("_runs"))
        add = lambda s, run: let(inner(s, run), lambda r: F.struct(*[r[n].alias(n) for n in start], F.concat(s["_runs"], F.array(r["_out"])).alias("_runs")))
        return F.when(F.size(all_) > 0, F.flatten(F.aggregate(parts, first, add)["_runs"])).otherwise(none)

    return let(items, runs)


def _places(norm: Column, pattern: Column) -> Column:
    """First and last word (from 0) of all matches, in order: pieces between matches are counted."""
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    hits = F.regexp_extract_all(norm, pattern, F.lit(0))
    counted = let(hits, lambda h: F.when(F.size(h) > 0, F.zip_with(F.slice(F.split(norm, pattern, -1), 1, F.size(h)), h, lambda g, x: F.struct(blanks(g).alias("gap"), blanks(x).alias("hit")))))

    def step(a, z):
        here = a["at"] + z["gap"]
        return {"at": here + z["hit"]}, F.array(F.struct((here - 1).alias("first"), (here + z["hit"] - 1).alias("last")))

    return _walk(F.coalesce(counted, F.array().cast("array<struct<gap:int,hit:int>>")), {"at": F.lit(0)}, step, "struct<first:int,last:int>")


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. n_base counts all places
    of base phrases; first_word and last_word are their smallest and largest start, null without any.
    labels are those of detections left after suppression and all base labels, distinct, sorted,
    comma-joined. score is the share of evidence ``1 - product(1 - 0.25 * priority)`` over distinct
    (label, priority) of detections left, 0 without any. detections are (label, first, last, priority).
    A null or empty text has no words and no labels ('' and score 0). Repeated rows get equal results;
    columns of ``docs`` named like new ones are replaced; an empty table stays empty.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    keep = [c for c in docs.columns if c not in new]
    d = docs.select(F.struct(*keep).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = d.withColumn("_norm", F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.col("_text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" ")))
    d = d.withColumn("n_words", F.when(F.col("_norm") == "  ", 0).otherwise(F.length("_norm") - F.length(F.replace("_norm", F.lit(" "), F.lit(""))) - 1).cast("long"))
    d = d.drop("_text")
    # The keyword gate: one pass over the text with all keywords.
    words = sorted({r[2] for r in rules()} | {p.split()[0] for p, _ in BASE})
    # Most texts hold none of the two or three words without which no rule can match.
    d = d.withColumn("_keys", F.array_distinct(F.regexp_extract_all("_norm", F.lit("(?<= )(" + "|".join(words) + ")(?= )"), F.lit(1))))
    table = _rows(rules(), ["rank", "label", "key", "pattern", "priority"])
    norm = F.col("_norm")
    found = F.flatten(F.transform(
        F.filter(table, lambda r: F.array_contains(F.col("_keys"), r["key"])),
        lambda r: F.transform(_places(norm, r["pattern"]), lambda p: F.struct(
            p["first"].alias("first"), (-p["last"]).alias("minus_last"), (-r["priority"]).alias("minus_priority"), r["rank"].alias("rank"), r["label"].alias("label"))),
    ))
    found = F.when(F.size("_keys") > 0, F.array_sort(found)).otherwise(F.array().cast("array<struct<first:int,minus_last:int,minus_priority:int,rank:int,label:string>>"))
    d = d.withColumn("_found", found)
    # Sorted by first word, longest first: a detection lies inside an earlier one if that reaches as far.

    def suppress(a, x):
        last, p = -x["minus_last"], -x["minus_priority"]
        most = F.when(p == 3, a["r3"]).when(p == 2, F.greatest(a["r2"], a["r3"])).otherwise(F.greatest(a["r1"], a["r2"], a["r3"]))
        up = lambda k, r: F.when(p == k, F.greatest(r, last)).otherwise(r)
        one = F.array(F.struct(x["label"].alias("label"), x["first"].alias("first"), last.alias("last"), p.alias("priority")))
        return {"r1": up(1, a["r1"]), "r2": up(2, a["r2"]), "r3": up(3, a["r3"])}, F.when(most >= last, F.slice(one, 1, 0)).otherwise(one)

    d = d.withColumn("detections", _walk(F.col("_found"), {r: F.lit(-1) for r in ("r1", "r2", "r3")}, suppress, "struct<label:string,first:int,last:int,priority:int>"))
    base = _rows(BASE, ["phrase", "label"])
    places = F.flatten(F.transform(
        F.filter(base, lambda b: F.array_contains(F.col("_keys"), F.split(b["phrase"], " ")[0])),
        lambda b: F.transform(_places(norm, F.concat(F.lit("(?<= )"), b["phrase"], F.lit("(?= )"))), lambda p: F.struct(p["first"].alias("first"), b["label"].alias("label"))),
    ))
    d = d.withColumn("_base", F.when(F.size("_keys") > 0, places).otherwise(F.array().cast("array<struct<first:int,label:string>>")))
    d = d.withColumn("n_base", F.size("_base").cast("long"))
    d = d.withColumn("first_word", F.array_min(F.col("_base.first")).cast("long")).withColumn("last_word", F.array_max(F.col("_base.first")).cast("long"))
    own = F.array_distinct(F.col("_base.label"))
    d = d.withColumn("base_labels", F.array_join(F.array_sort(own), ","))
    d = d.withColumn("labels", F.array_join(F.array_sort(F.array_union(own, F.col("detections.label"))), ","))
    kinds = F.array_distinct(F.transform("detections", lambda x: F.struct(x["label"].alias("label"), x["priority"].alias("priority"))))
    d = d.withColumn("score", F.lit(1.0) - F.aggregate(kinds, F.lit(1.0), lambda a, k: a * (1.0 - 0.25 * k["priority"])))
    return d.select(*[F.col("_row").getField(c).alias(c) for c in keep], *new)


def op4_scan_licenses(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).drop("text", "detections")
