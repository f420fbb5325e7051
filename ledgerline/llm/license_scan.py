"""License scans by ordered signature rules.

Text is read as words (A-Z lower-cased; letters, digits and all non-ASCII
characters belong to words) joined by single blanks.  Rules are regexes over that
string with a label, a priority and a keyword; a rule's regex runs only where its
keyword stands.  Texts that hold no rule's anchor (a word that stands wherever the
rule finds anything) are told by one pattern on the raw text and skip all of them.
There are rules for names (bare, in a grant, with versions, as SPDX identifiers),
for short forms, for the addresses of licence texts and for the texts themselves.
A detection inside one of the same or a higher priority is suppressed, the
earlier rule winning on equal places.  Four base phrases are counted besides;
their labels always stay.

Everything is one pass of array functions over each row: no join, no shuffle.
Null and empty texts have no words, no labels and score 0.  Repeated rows are
scanned alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
_L = "licen[cs]e"
#: Signatures: label, name pattern, keyword that the name holds, versions.
FAMILIES = (
    ("gpl", f"gnu general public {_L}", "gnu general public", ("1", "2", "3")),
    ("gpl", "gnu gpl", "gnu gpl", ("1", "2", "3")),
    ("gpl", "gplv", "gplv", ()),
    ("lgpl", f"gnu (?:lesser|library) general public {_L}", "general public", ("2", "2 1", "3")),
    ("lgpl", "gnu lgpl", "gnu lgpl", ("2", "2 1", "3")),
    ("agpl", f"gnu affero general public {_L}", "affero", ("3",)),
    ("gfdl", f"gnu free documentation {_L}", "free documentation", ("1 1", "1 2", "1 3")),
    ("apache", f"apache(?: software)? {_L}", "apache", ("1 0", "1 1", "2 0")),
    ("mit", f"mit(?: style)? {_L}", "mit", ()),
    ("mit", "expat licen[cs]e", "expat", ()),
    ("bsd", f"bsd(?: style)? {_L}", "bsd", ()),
    ("bsd-2-clause", f"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: {_L})?", "bsd", ()),
    ("bsd-2-clause", f"freebsd(?: {_L})?", "freebsd", ()),
    ("bsd-3-clause", f"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {_L})?", "bsd", ()),
    ("bsd-4-clause", f"(?:bsd 4 clause|4 clause bsd|original bsd)(?: {_L})?", "bsd", ()),
    ("0bsd", f"0bsd(?: {_L})?", "0bsd", ()),
    ("0bsd", f"zero clause bsd(?: {_L})?", "zero clause bsd", ()),
    ("isc", f"isc {_L}", "isc", ()),
    ("mpl", f"mozilla public {_L}", "mozilla", ("1 0", "1 1", "2 0")),
    ("epl", f"eclipse public {_L}", "eclipse", ("1 0", "2 0")),
    ("edl", f"eclipse distribution {_L}", "eclipse", ("1 0",)),
    ("cddl", f"common development and distribution {_L}", "common development", ("1 0", "1 1")),
    ("cpl", f"common public {_L}", "common public", ("1 0",)),
    ("cpal", f"common public attribution {_L}", "attribution", ("1 0",)),
    ("ipl", f"ibm public {_L}", "ibm public", ("1 0",)),
    ("artistic", f"artistic {_L}", "artistic", ("1 0", "2 0")),
    ("zlib", f"zlib(?: libpng)? {_L}", "zlib", ()),
    ("libpng", f"libpng {_L}", "libpng", ("2",)),
    ("bsl", f"boost software {_L}", "boost software", ("1 0",)),
    ("wtfpl", "do what the [a-z]+ you want to public licen[cs]e", "you want to public", ("1", "2")),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("unlicense", "(?:the unlicense|unlicense org|released under the unlicense)", "unlicense", ()),
    ("cc0", f"cc0(?: {_L})?", "cc0", ("1 0",)),
    ("cc0", "creative commons zero", "creative commons zero", ("1 0",)),
    ("cc-by", "cc by", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative commons attribution", "creative commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by sa", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "creative commons attribution share ?alike", "creative commons", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc by nc", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "creative commons attribution non ?commercial", "creative commons", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc by nd", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "creative commons attribution no ?derivatives", "creative commons", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("ofl", f"(?:sil )?open font {_L}", "open font", ("1 0", "1 1")),
    ("odbl", f"open (?:data commons open )?database {_L}", "database", ("1 0",)),
    ("odc-by", f"open data commons attribution {_L}", "open data commons", ("1 0",)),
    ("pddl", "public domain dedication and licen[cs]e", "public domain dedication", ("1 0",)),
    ("eupl", f"european union public {_L}", "european union", ("1 0", "1 1", "1 2")),
    ("osl", f"open software {_L}", "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", f"academic free {_L}", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ecl", f"educational community {_L}", "educational community", ("1 0", "2 0")),
    ("ms-pl", f"microsoft public {_L}", "microsoft", ()),
    ("ms-rl", f"microsoft reciprocal {_L}", "microsoft", ()),
    ("psf", f"python software foundation {_L}", "python software foundation", ("2",)),
    ("psf", f"psf {_L}", "psf", ("2",)),
    ("python", f"python {_L}", "python", ("2 0",)),
    ("php", f"php {_L}", "php", ("3 0", "3 01")),
    ("ruby", f"ruby {_L}", "ruby", ()),
    ("postgresql", f"postgresql {_L}", "postgresql", ()),
    ("openssl", f"openssl {_L}", "openssl", ()),
    ("x11", f"x11 {_L}", "x11", ()),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", "ncsa", ()),
    ("sleepycat", f"sleepycat {_L}", "sleepycat", ()),
    ("zpl", f"zope public {_L}", "zope", ("1 1", "2 0", "2 1")),
    ("vim", f"vim {_L}", "vim", ()),
    ("w3c", f"w3c software(?: notice and)? {_L}", "w3c", ()),
    ("lppl", f"latex project public {_L}", "latex project", ("1 0", "1 1", "1 2", "1 3")),
    ("qpl", f"q public {_L}", "q public", ("1 0",)),
    ("spl", f"sun public {_L}", "sun public", ("1 0",)),
    ("apsl", f"apple public source {_L}", "apple public", ("1 0", "1 1", "1 2", "2 0")),
    ("wxwindows", f"wxwindows library {_L}", "wxwindows", ("3 1",)),
    ("openldap", f"openldap public {_L}", "openldap", ("2 8",)),
    ("sspl", f"server side public {_L}", "server side public", ("1",)),
    ("busl", f"business source {_L}", "business source", ("1 0", "1 1")),
    ("elastic", f"elastic {_L}", "elastic", ("1", "2", "2 0")),
    ("polyform", f"polyform [a-z]+ {_L}", "polyform", ("1 0 0",)),
    ("commons-clause", "commons clause", "commons clause", ("1 0",)),
    ("json", f"json {_L}", "json", ()),
    ("beerware", f"beer ?ware(?: {_L})?", "beer", ()),
    ("cecill", f"cecill(?: {_L})?", "cecill", ("1 0", "2 0", "2 1")),
    ("mulan-psl", f"mulan permissive software {_L}", "mulan", ("1", "2")),
    ("upl", f"universal permissive {_L}", "universal permissive", ("1 0",)),
    ("vsl", f"vovida software {_L}", "vovida", ("1 0",)),
    ("entessa", f"entessa public {_L}", "entessa", ("1 0",)),
    ("frameworx", f"frameworx {_L}", "frameworx", ("1 0",)),
    ("nasa", f"nasa open source agreement", "nasa open source", ("1 3",)),
    ("open-group", f"open group test suite {_L}", "open group", ()),
    ("openrail", f"openrail(?: m)?(?: {_L})?", "openrail", ()),
    ("openrail", f"open rail(?: m)?(?: {_L})?", "open rail", ()),
    ("llama", f"llama [0-9]+ community {_L}", "llama", ()),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", ()),
    ("proprietary", "confidential and proprietary", "confidential and proprietary", ()),
    ("proprietary", f"commercial {_L}", "commercial", ()),
    ("proprietary", f"end user {_L} agreement", "end user", ()),
    ("all-rights-reserved", "all rights reserved", "rights reserved", ()),
    ("public-domain", "(?:in|into|to) the public domain", "public domain", ()),
    ("freeware", "freeware", "freeware", ()),
    ("copyleft", "copyleft", "copyleft", ()),
    ("copyright-notice", "copyright(?: c)? [0-9]{4}", "copyright", ()),
)
#: Short forms and addresses: label, pattern, keyword.
FORMS = (
    ("gpl-2.0", "gpl ?v?2(?: 0)?(?: only| or later)?", "gpl"), ("gpl-3.0", "gpl ?v?3(?: 0)?(?: only| or later)?", "gpl"), ("gpl", "gpl licensed", "gpl licensed"),
    ("lgpl-2.1", "lgpl ?v?2 1(?: only| or later)?", "lgpl"), ("lgpl-3.0", "lgpl ?v?3(?: 0)?(?: only| or later)?", "lgpl"), ("agpl-3.0", "agpl ?v?3(?: 0)?(?: only| or later)?", "agpl"),
    ("apache-2.0", "apache 2 0", "apache 2"), ("apache-2.0", "apache v2", "apache v2"), ("apache-2.0", "apache licen[cs]ed", "apache licen"), ("asl-2.0", "asl ?2 0", "asl"),
    ("mit", "mit licen[cs]ed", "mit licen"), ("mit", "mit x11", "mit x11"), ("bsd", "bsd licen[cs]ed", "bsd licen"), ("isc", "isc licen[cs]ed", "isc licen"),
    ("mpl-2.0", "mpl ?v?2 0", "mpl"), ("mpl-1.1", "mpl ?v?1 1", "mpl"), ("epl-1.0", "epl ?v?1 0", "epl"), ("epl-2.0", "epl ?v?2 0", "epl"), ("cddl-1.0", "cddl ?v?1 0", "cddl"),
    ("cc-by-4.0", "attribution 4 0 international", "attribution 4 0"), ("cc-by-sa-4.0", "attribution share ?alike 4 0 international", "attribution share"), ("cc-by-nc-4.0", "attribution non ?commercial 4 0 international", "attribution non"),
    ("dual-license", "dual(?:ly)? licen[cs]ed(?: under)?", "dual"), ("osi-approved", "osi approved(?: open source)?", "osi approved"), ("open-source", "open source licen[cs]e", "open source"), ("source-available", "source available licen[cs]e", "source available"),
    ("mit", "opensource org licen[cs]es mit", "opensource org"), ("bsd-3-clause", "opensource org licen[cs]es bsd 3 clause", "opensource org"), ("bsd-2-clause", "opensource org licen[cs]es bsd 2 clause", "opensource org"), ("isc", "opensource org licen[cs]es isc", "opensource org"),
    ("apache-2.0", "apache org licen[cs]es licen[cs]e 2 0", "apache org"), ("mpl-2.0", "mozilla org (?:en us )?mpl 2 0", "mozilla org"), ("epl-2.0", "eclipse org (?:legal )?epl (?:v20|2 0)", "eclipse org"), ("epl-1.0", "eclipse org (?:legal )?epl (?:v10|1 0)", "eclipse org"),
    ("gpl-2.0", "gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0", "gnu org"), ("gpl-3.0", "gnu org licen[cs]es gpl(?: 3 0)?", "gnu org"), ("lgpl", "gnu org licen[cs]es lgpl(?: 3 0)?", "gnu org"), ("agpl-3.0", "gnu org licen[cs]es agpl(?: 3 0)?", "gnu org"), ("gfdl", "gnu org licen[cs]es fdl", "gnu org"),
    ("cc-by-4.0", "creativecommons org licen[cs]es by 4 0", "creativecommons org"), ("cc-by-3.0", "creativecommons org licen[cs]es by 3 0", "creativecommons org"), ("cc-by-sa-4.0", "creativecommons org licen[cs]es by sa 4 0", "creativecommons org"), ("cc-by-sa-3.0", "creativecommons org licen[cs]es by sa 3 0", "creativecommons org"),
    ("cc-by-nc-4.0", "creativecommons org licen[cs]es by nc 4 0", "creativecommons org"), ("cc-by-nd-4.0", "creativecommons org licen[cs]es by nd 4 0", "creativecommons org"), ("cc-by-nc-sa-4.0", "creativecommons org licen[cs]es by nc sa 4 0", "creativecommons org"), ("cc-by-nc-nd-4.0", "creativecommons org licen[cs]es by nc nd 4 0", "creativecommons org"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", "creativecommons org"), ("public-domain", "creativecommons org publicdomain mark 1 0", "creativecommons org"), ("unlicense", "unlicense org", "unlicense"), ("wtfpl", "wtfpl net", "wtfpl"), ("ofl-1.1", "scripts sil org ofl", "scripts sil"), ("odbl-1.0", "opendatacommons org licen[cs]es odbl", "opendatacommons"), ("bsl-1.0", "boost org license 1 0", "boost org"),
)
#: Signatures of the texts and headers themselves: label, pattern, keyword.
BODIES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "this permission notice shall"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", "any person or organization obtaining"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose", "software and its documentation for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code"), ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form"),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products", "nor the names of its contributors"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "all advertising materials mentioning"),
    ("bsd", "this software is provided by the copyright holders and contributors as is", "provided by the copyright holders and contributors"),
    ("x11", "except as contained in this notice the name of", "except as contained in this notice"),
    ("apache-2.0", "you may not use this file except in compliance with the licen[cs]e", "except in compliance with the licen"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", "unless required by applicable law"),
    ("apache", "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements", "apache software foundation asf"),
    ("apache-2.0", "apache licen[cs]e version 2 0 january 2004", "january 2004"), ("apache-2.0", "terms and conditions for use reproduction and distribution", "use reproduction and distribution"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "program is free software you can redistribute"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "library is free software you can redistribute"),
    ("gpl-2.0", "either version 2 of the licen[cs]e or at your option any later version", "either version 2 of the licen"), ("gpl-3.0", "either version 3 of the licen[cs]e or at your option any later version", "either version 3 of the licen"),
    ("lgpl-2.1", "either version 2 1 of the licen[cs]e or at your option any later version", "either version 2 1 of the licen"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document", "distribute verbatim copies of this licen"), ("gpl", "you should have received a copy of the gnu general public licen[cs]e", "received a copy of the gnu general"),
    ("lgpl", "you should have received a copy of the gnu lesser general public licen[cs]e", "received a copy of the gnu lesser"), ("agpl", "you should have received a copy of the gnu affero general public licen[cs]e", "received a copy of the gnu affero"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "modify this document under the terms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[cs]e", "source code form is subject"), ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "file are subject to the mozilla"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "file are subject to the terms of the common development"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "accompanying materials are made available"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "without any express or implied warranty in no event"), ("zlib", "the origin of this software must not be misrepresented", "must not be misrepresented"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"), ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "publish use compile sell"),
    ("cc0", "has waived all copyright and related or neighboring rights", "waived all copyright"), ("cc", "this work is licensed under a creative commons", "licensed under a creative commons"), ("cc", "share copy and redistribute the material in any medium or format", "redistribute the material in any medium"),
    ("ofl", "this font software is licensed under the sil open font licen[cs]e", "font software is licensed"), ("php", "this source file is subject to version [0-9 ]{1,6} of the php licen[cs]e", "source file is subject to version"),
    ("psf", "psf is making python available to licensee on an as is basis", "making python available to licensee"), ("openssl", "this product includes software developed by the openssl project", "developed by the openssl project"),
    ("json", "the software shall be used for good not evil", "used for good not evil"), ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", "buy me a beer"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed", "verbatim or modified copies"),
    ("commons-clause", "the grant of rights under the licen[cs]e will not include .{0,80}?the right to sell the software", "right to sell the software"), ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "make non production use"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "state the conditions under which a package"), ("openrail", "use restrictions as referenced in paragraph 5", "use restrictions as referenced"),
    ("public-domain", "dedicated to the public domain", "dedicated to the public domain"), ("public-domain", "no rights reserved", "no rights reserved"), ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying of this file"),
    ("proprietary", "no part of this (?:publication|work|document) may be reproduced", "may be reproduced"), ("proprietary", "contains confidential and proprietary information of", "proprietary information of"),
    ("warranty-disclaimer", "provided as is without warranty of any kind", "without warranty of any kind"), ("warranty-disclaimer", "without even the implied warranty of merchantability", "implied warranty of merchantability"),
)
_GRANT = "(?:licensed|released|distributed|available|provided|published|covered|licenced) (?:under|by) (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?"
CONFIDENCE = {4: 1.0, 3: 0.95, 2: 0.85, 1: 0.6}


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, regex): for each family a bare name, a grant, and both with each version."""
    out = []
    for label, name, keyword, versions in FAMILIES:
        for version in versions:
            tag = f"{label}-{version.replace(' ', '.')}"
            number = f"(?: version| v| ver)? v?{version}" + ("(?: 0)?" if " " not in version else "")
            out.append((tag, 4, keyword, f" {_GRANT}{name}{number}(?= )"))
            out.append((tag, 3, keyword, f" {name}{number}(?= )"))
        out.append((label, 2, keyword, f" {_GRANT}{name}(?= )"))
        out.append((label, 1, keyword, f" {name}(?= )"))
        spdx = label.replace("-", " ")
        out.append((label, 2, "spdx licen", f" spdx licen[cs]e identifier {spdx}(?= )"))
        out += [(f"{label}-{v.replace(' ', '.')}", 4, "spdx licen", f" spdx licen[cs]e identifier {spdx} {v}(?= )") for v in versions]
    out += [(label, 3, keyword, f" {form}(?= )") for label, form, keyword in FORMS]
    out += [(label, 4, keyword, f" {body}(?= )") for label, body, keyword in BODIES]
    return list(dict.fromkeys(out))


def anchor(keyword: str, pattern: str) -> str:
    """What stands in every raw text in which the rule finds something: the word licence where the pattern cannot do
    without it, else the keyword with any separators between its words."""
    firm = re.sub(r"\(\?:[^()]*\)\??", " ", pattern.replace("(?= )", ""))
    return "licen[cs]e" if "licen[cs]e" in firm else SEPARATORS.join(keyword.split())


def gate(table: list[tuple[str, int, str, str]]) -> str:
    """A pattern for raw texts in which some rule of the table or a base phrase may find something: a part at the start
    of a word, one branch a letter.  Keywords stand at the start of a word of whatever their rule finds."""
    parts = {anchor(keyword, pattern) for _, _, keyword, pattern in table} | {"licen[cs]e"} | {SEPARATORS.join(phrase.split()) for phrase, _ in BASE if "license" not in phrase}
    # a part that holds another one, at the start of a word, is found with it
    least = sorted(w for w in parts if not any(v != w and (w.startswith(v) or SEPARATORS + v in w) for v in parts))
    return r"(?i)(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in least if w[0] == c)})" for c in sorted({w[0] for w in least})) + ")"


def _count_words(text: Column) -> Column:
    """Words of a piece in which a blank goes before each word."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(text: Column, pattern: Column, label: Column, priority: Column, order: Column) -> Column:
    """Detections of one rule: structs that sort by start, then longest, then priority, then rule."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.slice(F.split(text, pattern), F.lit(1), F.size(found))
    steps = F.zip_with(pieces, found, lambda p, m: F.struct(_count_words(p).alias("gap"), _count_words(m).alias("long")))
    entry = lambda at, x: F.struct((at + x["gap"]).alias("start"), (-(at + x["gap"] + x["long"])).alias("minus_end"), (-priority).alias("minus_priority"), order.alias("rule"), label.alias("label"))
    empty = F.array().cast("array<struct<start:int,minus_end:int,minus_priority:int,rule:int,label:string>>")
    walk = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda acc, x: F.struct((acc["at"] + x["gap"] + x["long"]).alias("at"), F.concat(acc["out"], F.array(entry(acc["at"], x))).alias("out")))
    return walk["out"]


def detections(text: Column, table: list[tuple[str, int, str, str]]) -> Column:
    """All detections of the rules in a word string, sorted."""
    column = lambda k: F.split(F.lit("\x1f".join(str(r[k]) for r in table)), "\x1f")  # noqa: E731  a constant array
    labels, priorities, keywords, patterns = (column(k) for k in range(4))
    hit = F.filter(F.sequence(F.lit(0), F.lit(len(table) - 1)), lambda i: F.contains(text, F.get(keywords, i)))
    each = F.transform(hit, lambda i: _places(text, F.get(patterns, i), F.get(labels, i), F.get(priorities, i).cast("int"), i))
    return F.sort_array(F.flatten(each))


def surviving(found: Column) -> Column:
    """Sorted detections without those inside one of the same or a higher priority."""
    start = F.struct(*[F.lit(-1).alias(f"end{p}") for p in (1, 2, 3, 4)], F.filter(found, lambda x: F.lit(False)).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end, priority = -x["minus_end"], -x["minus_priority"]
        reach = F.greatest(acc["end4"], *[F.when(priority <= p, acc[f"end{p}"]).otherwise(F.lit(-1)) for p in (1, 2, 3)])
        ends = [F.greatest(acc[f"end{p}"], F.when(priority == p, end).otherwise(F.lit(-1))).alias(f"end{p}") for p in (1, 2, 3, 4)]
        return F.struct(*ends, F.when(reach >= end, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"))

    return F.aggregate(found, start, step)["out"]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[tuple[str, int, str, str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    ``detections``, the surviving ones as (label, start, end, priority) in words."""
    table = rules() if table is None else table
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("text"))
    rows = rows.withColumns({"words": F.array_remove(F.split("text", SEPARATORS), ""), "gated": F.col("text").rlike(gate(table))})
    lower = F.translate(F.array_join("words", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rows.select("id", F.size("words").alias("n"), F.when(F.col("gated") & (F.size("words") > 0), F.concat(F.lit(" "), lower, F.lit(" "))).alias("norm"))
    counts, firsts, lasts, names = [], [], [], []
    for phrase, label in BASE:
        pattern = F.lit(f" {phrase}(?= )")
        has = F.contains("norm", F.lit(f" {phrase} "))
        pieces = F.split("norm", pattern)
        counts.append(F.when(has, F.size(pieces) - 1).otherwise(F.lit(0)))
        firsts.append(F.when(has, _count_words(F.element_at(pieces, 1))))
        lasts.append(F.when(has, F.col("n") - (_count_words(F.element_at(pieces, -1)) - 1) - len(phrase.split())))
        names.append(F.when(has, F.lit(label)))
    rows = rows.select(
        "id", F.col("n").cast("long").alias("n_words"),
        sum(counts, F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*names)).alias("base"),
        F.when(F.col("norm").isNotNull(), detections(F.col("norm"), table)).alias("found"),
    )
    rows = rows.withColumn("found", F.when(F.size("found") > 0, surviving(F.col("found"))))
    own = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    sure = F.lit(0.0)
    for p, c in sorted(CONFIDENCE.items()):
        sure = F.when(F.exists("found", lambda x: x["minus_priority"] == -p), F.lit(c)).otherwise(sure)  # noqa: B023
    score = F.greatest(F.coalesce(sure, F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(CONFIDENCE[1])).otherwise(F.lit(0.0)))
    spans = F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), (-x["minus_end"]).alias("end"), (-x["minus_priority"]).alias("priority")))
    return rows.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", own)).alias("labels"), score.alias("score"), spans.alias("detections"))
