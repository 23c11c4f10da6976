"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words with one space between; rules are regexes over that string. Each
rule has a keyword that all its matches contain and that must occur before the regex is tried, a label, a priority and a
confidence. Detections are taken by priority, then length, then place, then the rule's name; one that lies inside an interval
already taken is suppressed, so "gnu lesser general public license" is no second, plain GPL. Rules are of three kinds, some
hundreds in all: sentences of licences' texts and notices written out one by one, names in every phrasing that grants or cites a licence, and
machine-readable identifiers. The three base phrases are counted at all their places and their labels are never suppressed.

Cases: a null or empty text has no words and no labels and scores 0; equal rows are scanned one by one; a text of any
length is scanned whole, in time linear in its length and places; detections of equal priority, length and place go by the
rule's name; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corpusloom.llm.common import read, worker_state

#: Bytes that separate words become spaces, A-Z becomes a-z; bytes from 0x80 belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

# Phrases of the base and their labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

# Label, keyword (its first word is part of every match), pattern of the name (over folded words), pattern of versions or "".
LICENSES = (
    ("mit", "mit", r"(?:mit|expat|x11)", ""),
    ("apache", "apache", r"apache(?: software)?", r"(?:1 [01]|2(?: 0)?)"),
    ("gpl", "general public", r"(?:gnu )?general public", r"[123](?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?:v[123])?", r"[123](?: 0)?"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public", r"(?:2 1|3(?: 0)?)"),
    ("lgpl", "library general public", r"(?:gnu )?library general public", r"2(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?:v[23])?", r"(?:2 1|3(?: 0)?)"),
    ("agpl", "affero", r"(?:gnu )?affero general public", r"3(?: 0)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?:v3)?", r"3(?: 0)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", r"1 [123]"),
    ("mpl", "mozilla", r"mozilla public", r"(?:1 [01]|2(?: 0)?)"),
    ("epl", "eclipse", r"eclipse (?:public|distribution)", r"[12](?: 0)?"),
    ("cddl", "development and distribution", r"common development and distribution", r"1 [01]"),
    ("cpl", "common public", r"common public", r"(?:0 5|1 0)"),
    ("ibmpl", "ibm", r"ibm public", r"1 0"),
    ("bsd", "bsd", r"(?:(?:new|revised|simplified|modified|original|[0234] clause) )?bsd(?: [0234] clause)?", ""),
    ("isc", "licen", r"(?:isc|internet systems consortium)", ""),
    ("boost", "boost", r"boost software", r"1 0"),
    ("zlib", "zlib", r"(?:zlib|zlib libpng)", ""),
    ("libpng", "libpng", r"libpng", r"2(?: 0)?"),
    ("artistic", "artistic", r"(?:perl )?artistic", r"[12] 0"),
    ("unlicense", "unlicense", r"unlicense", ""),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public", r"2"),
    ("cc0", "cc0", r"(?:creative commons )?cc0", r"1 0"),
    ("cc-by", "creative commons attribution", r"creative commons attribution", r"[1234](?: [05])?"),
    ("cc-by-sa", "alike", r"creative commons attribution share ?alike", r"[1234](?: [05])?"),
    ("cc-by-nc", "commercial", r"creative commons attribution non ?commercial", r"[1234](?: [05])?"),
    ("cc-by-nd", "deriv", r"creative commons attribution no ?deriv(?:ative)?s?", r"[1234](?: [05])?"),
    ("eupl", "european union public", r"european union public", r"1 [012]"),
    ("osl", "open software", r"open software", r"[123] [01]"),
    ("afl", "academic free", r"academic free", r"[123] [012]"),
    ("ofl", "open font", r"(?:sil )?open font", r"1 [01]"),
    ("python", "python", r"python(?: software foundation)?", r"[23](?: [0-9])*"),
    ("php", "php", r"php", r"3 0[01]?"),
    ("ruby", "ruby", r"ruby", ""),
    ("postgresql", "postgresql", r"postgresql", ""),
    ("openssl", "ssl", r"(?:openssl|ssleay)", ""),
    ("ms-pl", "microsoft public", r"microsoft public", ""),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", ""),
    ("apsl", "apple", r"apple public source", r"[12] [012]"),
    ("qpl", "q public", r"q public", r"1 0"),
    ("lppl", "latex", r"latex project public", r"1 [0-3]c?"),
    ("upl", "universal permissive", r"universal permissive", r"1 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", ""),
    ("w3c", "w3c", r"w3c(?: software)?", ""),
    ("vim", "vim", r"vim", ""),
    ("zpl", "zope", r"zope public", r"[12] [01]"),
    ("sspl", "server side public", r"server side public", r"1"),
    ("bsl", "business source", r"business source", r"1 1"),
    ("elastic", "elastic", r"elastic", r"2(?: 0)?"),
    ("odbl", "open database", r"(?:odc )?open database", r"1 0"),
    ("odc-by", "open data commons", r"open data commons attribution", r"1 0"),
    ("cecill", "cecill", r"cecill(?: [bc])?", r"[12](?: [01])?"),
    ("mulan", "mulan", r"mulan(?: permissive software)?", r"[12]"),
    ("blueoak", "blue oak", r"blue oak model", r"1 0 0"),
)

# Phrasings around a name {n} with version {v}; the priority and confidence of each.
PHRASINGS = (
    (r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{n} licen[cs]e(?: version)?(?: {v})?", 60, 0.99),
    (r"subject to (?:the )?(?:terms of )?(?:the )?{n} licen[cs]e(?: version)?(?: {v})?", 55, 0.95),
    (r"under (?:the )?(?:terms of )?(?:the )?{n} licen[cs]e(?: version)?(?: {v})?", 50, 0.9),
    (r"{n} licen[cs]e (?:version |v)?{v}(?: or (?:any )?later(?: version)?)?", 45, 0.95),
    (r"(?:the )?{n} licen[cs]e", 30, 0.8),
    (r"licen[cs]e {n}(?: {v})?", 25, 0.7),
)

# Rules of whole sentences: label, keyword, pattern, priority, confidence.
SENTENCES = (
    ("mit", "hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy", 80, 0.99),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose", 80, 0.97),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 80, 0.97),
    ("bsd", "endorse or promote", r"(?:neither the name|the names?) of .{0,80}may (?:not )?be used to endorse or promote products", 75, 0.9),
    ("gpl", "free software you can redistribute", r"this program is free software you can redistribute it and or modify it", 80, 0.97),
    ("lgpl", "this library is free software", r"this library is free software you can redistribute it and or modify it", 80, 0.97),
    ("apache", "you may not use this file", r"you may not use this file except in compliance with the license", 80, 0.95),
    ("zlib", "arising from the use of this", r"in no event will the authors be held liable for any damages arising from the use of this software", 80, 0.95),
    ("boost", "organization obtaining a copy", r"granted free of charge to any person or organization obtaining a copy", 80, 0.97),
    ("unlicense", "unencumbered software", r"free and unencumbered software released into the public domain", 85, 0.99),
    ("public-domain", "public domain", r"(?:released into|dedicated to|placed in|in) the public domain", 20, 0.6),
    ("cc", "creative commons", r"creative commons licen[cs]e", 20, 0.6),
    ("proprietary", "all rights reserved", r"all rights reserved", 10, 0.2),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 40, 0.8),
)

# Sentences of licences' texts and of the notices that apply them, and references to them.
SENTENCES += (
    ("gpl", "general public license as published", r"terms of the gnu general public license as published by the free software foundation(?: either version [123])?", 82, 0.99),
    ("gpl", "protect your rights", r"to protect your rights we need to (?:make restrictions|prevent others)", 70, 0.9),
    ("gpl", "changed the files and the date", r"carry prominent notices stating that you changed the files and the date of any change", 72, 0.95),
    ("gpl", "useful but without any warranty", r"in the hope that it will be useful but without any warranty", 40, 0.7),
    ("gpl", "freedom to share", r"(?:designed|intended) to guarantee your freedom to share and change", 72, 0.95),
    ("gpl", "copyleft license for", r"(?:is )?a free copyleft license for software and other kinds of works", 72, 0.95),
    ("gpl", "gnu org licenses gpl", r"gnu org licenses gpl(?: [123] 0)?(?: html| txt)?", 60, 0.9),
    ("lgpl", "lesser general public license as published", r"terms of the gnu lesser general public license as published by the free software foundation", 84, 0.99),
    ("lgpl", "library general public license as published", r"terms of the gnu library general public license as published by the free software foundation", 84, 0.99),
    ("lgpl", "works that use the library", r"works that use the library", 65, 0.85),
    ("lgpl", "specially designated software packages", r"some specially designated software packages typically libraries", 72, 0.95),
    ("lgpl", "gnu org licenses lgpl", r"gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?", 61, 0.9),
    ("agpl", "affero general public license as published", r"terms of the gnu affero general public license as published by the free software foundation", 84, 0.99),
    ("agpl", "remotely through a computer network", r"interacting with it remotely through a computer network", 74, 0.95),
    ("agpl", "gnu org licenses agpl", r"gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 61, 0.9),
    ("gfdl", "invariant sections", r"with no invariant sections(?: no front cover texts and no back cover texts)?", 76, 0.97),
    ("gfdl", "functional and useful document", r"make a manual textbook or other functional and useful document free", 72, 0.95),
    ("apache", "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements", 84, 0.99),
    ("apache", "apache org licenses", r"(?:www )?apache org licenses(?: license [12] [01])?", 60, 0.95),
    ("apache", "distributed on an as is basis", r"distributed under the license is distributed on an as is basis", 72, 0.9),
    ("apache", "perpetual worldwide non exclusive", r"grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", 72, 0.9),
    ("apache", "redistribution must", r"redistribution must include the following acknowled?gment this product includes software developed by the apache", 74, 0.95),
    ("mit", "above copyright notice and this permission notice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 82, 0.98),
    ("mit", "deal in the software without restriction", r"to deal in the software without restriction", 78, 0.97),
    ("mit", "tort or otherwise arising from", r"whether in an action of contract tort or otherwise arising from out of or in connection with the software", 70, 0.9),
    ("mit", "opensource org licenses mit", r"opensource org licenses mit(?: license)?(?: php| html)?", 60, 0.95),
    ("mit", "mit licensed", r"(?:is |are )?mit licensed", 35, 0.85),
    ("x11", "x consortium shall not be used", r"the name of the x consortium shall not be used in advertising", 78, 0.97),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice", 78, 0.95),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice", 78, 0.95),
    ("bsd", "mentioning features or use", r"all advertising materials mentioning features or use of this software must display", 76, 0.95),
    ("bsd", "procurement of substitute goods", r"procurement of substitute goods or services loss of use data or profits", 60, 0.8),
    ("bsd", "bsd style license", r"(?:under an? )?bsd style license", 45, 0.85),
    ("bsd", "opensource org licenses bsd", r"opensource org licenses bsd(?: license)?(?: php)?", 60, 0.95),
    ("isc", "performance of this software", r"use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", 74, 0.9),
    ("isc", "isc licensed", r"isc licensed", 35, 0.85),
    ("mpl", "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public license(?: v)?(?: 2 0)?", 84, 0.99),
    ("mpl", "mozilla org", r"(?:www )?mozilla org (?:mpl|en us mpl)(?: [12] [01])?", 60, 0.95),
    ("mpl", "incompatible with secondary licenses", r"incompatible with secondary licenses", 70, 0.9),
    ("mpl", "contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public license", 84, 0.99),
    ("npl", "contents of this file are subject to the netscape", r"the contents of this file are subject to the netscape public license", 84, 0.99),
    ("epl", "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 84, 0.99),
    ("epl", "eclipse org", r"(?:www )?eclipse org (?:legal|org documents) e[pd]l(?: v)?(?: ?[12]0| [12] 0)?(?: html)?", 60, 0.95),
    ("cpl", "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the common public license", 84, 0.99),
    ("cddl", "subject to the terms of the common development", r"the contents of this file are subject to the terms of the common development and distribution license", 84, 0.99),
    ("cddl", "opensolaris org os licensing", r"opensolaris org os licensing", 60, 0.9),
    ("boost", "boost org license", r"(?:www )?boost org license 1 0 txt", 60, 0.97),
    ("boost", "machine executable object code", r"machine executable object code generated by a source language processor", 74, 0.95),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 78, 0.97),
    ("zlib", "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented", 78, 0.97),
    ("libpng", "png reference library", r"png reference library is supplied as is", 76, 0.95),
    ("artistic", "semblance of artistic control", r"maintains? some semblance of artistic control", 76, 0.97),
    ("artistic", "same terms as perl", r"(?:under the )?same terms as perl(?: itself)?", 60, 0.9),
    ("unlicense", "unlicense org", r"(?:refer to )?(?:https? )?unlicense org", 60, 0.95),
    ("unlicense", "any and all copyright interest", r"dedicates? any and all copyright interest in the software to the public domain", 76, 0.95),
    ("wtfpl", "you just do what", r"you just do what the fuck you want to", 80, 0.97),
    ("cc0", "waived all copyright and related", r"waived all copyright and related or neighboring rights", 78, 0.97),
    ("cc0", "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero 1 0", 70, 0.98),
    ("public-domain", "creativecommons org publicdomain mark", r"creativecommons org publicdomain mark 1 0", 70, 0.95),
    ("cc-by", "creativecommons org licenses by", r"creativecommons org licenses by(?: [1234] [05])?", 68, 0.97),
    ("cc-by-sa", "creativecommons org licenses by sa", r"creativecommons org licenses by sa(?: [1234] [05])?", 69, 0.98),
    ("cc-by-nc", "creativecommons org licenses by nc", r"creativecommons org licenses by nc(?: (?:sa|nd))?(?: [1234] [05])?", 69, 0.98),
    ("cc-by-nd", "creativecommons org licenses by nd", r"creativecommons org licenses by nd(?: [1234] [05])?", 69, 0.98),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1234] [05])?", 50, 0.9),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: (?:sa|nd))?(?: [1234] [05])?", 50, 0.9),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1234] [05])?", 50, 0.9),
    ("cc-by", "cc by", r"cc by [1234] [05]", 48, 0.85),
    ("eupl", "licensed under the eupl", r"licensed under the eupl(?: version)?(?: 1 [012])?", 70, 0.97),
    ("osl", "licensed under the open software license", r"licensed under the open software license version [123] [01]", 74, 0.97),
    ("afl", "licensed under the academic free license", r"licensed under the academic free license version [123] [012]", 74, 0.97),
    ("ofl", "reserved font name", r"with reserved font names?", 70, 0.95),
    ("ofl", "scripts sil org ofl", r"scripts sil org ofl", 60, 0.95),
    ("python", "python software foundation", r"python software foundation(?: psf)? is making python available", 76, 0.97),
    ("python", "all rights reserved", r"copyright (?:c )?(?:[0-9]{4} )+python software foundation all rights reserved", 60, 0.9),
    ("php", "product includes php", r"this product includes php(?: software)? freely available from", 76, 0.97),
    ("php", "php net license", r"(?:www )?php net license(?: 3 01? txt)?", 60, 0.95),
    ("ruby", "same terms as ruby", r"same terms as ruby(?: itself)?", 60, 0.9),
    ("postgresql", "university of california be liable", r"in no event shall the university of california be liable to any party", 72, 0.9),
    ("openssl", "openssl toolkit", r"developed by the openssl project for use in the openssl toolkit", 78, 0.97),
    ("ssleay", "cryptographic software written by", r"includes cryptographic software written by eric young", 78, 0.97),
    ("ms-pl", "accept this license", r"if you use the software you accept this license if you do not accept the license do not use the software", 74, 0.93),
    ("apsl", "original code and or modifications", r"this file contains original code and or modifications of original code as defined in", 78, 0.97),
    ("lppl", "conditions of the latex project", r"under the conditions of the latex project public license(?: either version 1 [0-3]c?)?", 80, 0.98),
    ("lppl", "latex project org lppl", r"latex project org lppl(?: lppl)?(?: 1 [0-3]c?)?(?: txt| html)?", 60, 0.95),
    ("ncsa", "deal with the software without restriction", r"to deal with the software without restriction", 78, 0.95),
    ("w3c", "w3 org consortium legal", r"(?:www )?w3 org consortium legal", 60, 0.9),
    ("vim", "vim is charityware", r"vim is charityware", 76, 0.97),
    ("zpl", "zope public license", r"subject to the provisions of the zope public license(?: version [12] [01])?", 80, 0.98),
    ("sspl", "offering the program as a service", r"offering the program as a service", 76, 0.95),
    ("bsl", "additional use grant", r"additional use grant", 70, 0.9),
    ("bsl", "change date", r"(?:on the|the) change date (?:and|or) the", 55, 0.7),
    ("elastic", "hosted or managed service", r"provide the software to third parties as a hosted or managed service", 76, 0.95),
    ("odbl", "opendatacommons org licenses odbl", r"opendatacommons org licenses odbl(?: 1 0)?", 66, 0.97),
    ("odc-by", "opendatacommons org licenses by", r"opendatacommons org licenses by(?: 1 0)?", 66, 0.97),
    ("cecill", "governed by the cecill", r"this software is governed by the cecill(?: [bc])? license", 80, 0.98),
    ("cecill", "cecill info", r"(?:www )?cecill info", 60, 0.9),
    ("mulan", "mulan psl", r"mulan psl ?v[12]", 70, 0.97),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?", 70, 0.95),
    ("json", "good not evil", r"the software shall be used for good not evil", 82, 0.99),
    ("beerware", "beer ware license", r"the beer ware license(?: revision 42)?", 78, 0.98),
    ("hippocratic", "hippocratic license", r"hippocratic license(?: version)?(?: [123] [01])?", 60, 0.95),
    ("curl", "permission to use copy modify", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 79, 0.9),
    ("hpnd", "permission to use copy modify", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 81, 0.97),
    ("ntp", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 82, 0.97),
    ("fair", "usage of the works is permitted", r"usage of the works is permitted provided that this instrument is retained", 82, 0.99),
    ("freetype", "freetype project license", r"(?:the )?freetype project license", 60, 0.95),
    ("ijg", "independent jpeg group", r"based in part on the work of the independent jpeg group", 76, 0.97),
    ("unicode", "unicode inc", r"unicode inc license agreement data files and software", 78, 0.98),
    ("icu", "icu license", r"icu license(?: icu 1 8 1 and later)?", 60, 0.95),
    ("tcl", "copyrighted by the regents", r"this software is copyrighted by the regents of the university of california sun microsystems", 78, 0.97),
    ("proprietary", "trade secret", r"(?:contains|is) (?:the )?(?:confidential|proprietary) (?:information and )?trade secrets?", 45, 0.8),
    ("proprietary", "may not be reproduced", r"may not be reproduced (?:or )?(?:distributed )?(?:in any form )?without (?:the )?(?:prior |express )?written (?:permission|consent)", 45, 0.75),
    ("proprietary", "unauthorized copying", r"unauthorized copying of (?:this|these) (?:file|files|software|document) (?:via any medium )?is strictly prohibited", 60, 0.95),
    ("proprietary", "end user license agreement", r"end user license agreement", 30, 0.6),
    ("proprietary", "internal use only", r"for internal use only", 15, 0.3),
)

# Identifiers after "spdx license identifier" and their labels.
SPDX = (
    ("mit", r"mit"), ("apache", r"apache 2 0"), ("gpl", r"gpl [123] 0(?: only| or later)?"), ("lgpl", r"lgpl [23] [01](?: only| or later)?"),
    ("agpl", r"agpl 3 0(?: only| or later)?"), ("mpl", r"mpl [12] [01]"), ("bsd", r"bsd [234] clause"), ("isc", r"isc"), ("epl", r"epl [12] 0"),
    ("cc0", r"cc0 1 0"), ("boost", r"bsl 1 0"), ("zlib", r"zlib"), ("unlicense", r"unlicense"), ("cddl", r"cddl 1 [01]"), ("eupl", r"eupl 1 [12]"),
    ("cc-by", r"cc by [1234] 0"), ("cc-by-sa", r"cc by sa [1234] 0"), ("ofl", r"ofl 1 [01]"), ("artistic", r"artistic [12] 0"),
)

#: No pattern spans more words than this.
LONGEST = 128


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: bytes
    pattern: str
    priority: int
    confidence: float


def build_rules() -> list[Rule]:
    out = []
    for k, (label, keyword, name, version) in enumerate(LICENSES):
        for j, (phrase, priority, confidence) in enumerate(PHRASINGS):
            if "{v}" in phrase and "(?: {v})?" not in phrase and not version:
                continue
            pattern = phrase.replace("(?: {v})?", f"(?: {version})?" if version else "").replace("{v}", version).replace("{n}", name)
            out.append(Rule(f"{label}-{k}-{j}", label, keyword.split()[0].encode() if k else b"licen", pattern, priority, confidence))
    out += [Rule(f"sentence-{k}", label, keyword.encode(), pattern, priority, confidence) for k, (label, keyword, pattern, priority, confidence) in enumerate(SENTENCES)]
    out += [Rule(f"spdx-{k}", label, b"spdx license identifier", f"spdx license identifier {pattern}", 90, 0.999) for k, (label, pattern) in enumerate(SPDX)]
    return out


#: A text without any of these can match no rule: "licen" stands in all that name a licence or an identifier.
STEMS = tuple(dict.fromkeys([b"licen", *(keyword.encode() for _, keyword, _, _, _ in SENTENCES if "licen" not in keyword)]))


def _compiled() -> list[tuple[Rule, re.Pattern[bytes]]]:
    return [(r, re.compile(rb"(?<= )(?:" + r.pattern.encode() + rb")(?= )")) for r in build_rules()]


def fold(text: str | None) -> list[bytes]:
    """The text's words, lower-cased, as UTF-8."""
    return (text or "").encode().translate(FOLD).split()


def spaces_of(line: bytes) -> np.ndarray:
    """Places of the spaces: the word after the k-th one is word k."""
    return np.flatnonzero(np.frombuffer(line, np.uint8) == 32)


def base_places(line: bytes, spaces: np.ndarray | None = None) -> list[tuple[int, str]]:
    """Start word and label of every place of a base phrase; line: words with one space before, between and after."""
    at, labels = [], []
    for phrase, label in BASE:
        k = line.find(b" " + phrase + b" ")
        while k >= 0:
            at.append(k)
            labels.append(label)
            k = line.find(b" " + phrase + b" ", k + 1)
    if not at:
        return []
    words = np.searchsorted(spaces_of(line) if spaces is None else spaces, at).tolist()
    return sorted(zip(words, labels, strict=True))


def detect(line: bytes, rules: list[tuple[Rule, re.Pattern[bytes]]], gated: bool = True) -> list[tuple[str, str, int, int, float]]:
    """Detections that hold: rule, label, first word, word after the last, confidence, in order of place.

    gated: rules whose keyword does not occur are not tried, which changes nothing but the time.
    """
    if gated and not any(s in line for s in STEMS):
        return []
    known: dict[bytes, bool] = {}
    at, hits = [], []
    for rule, pattern in rules:
        if rule.keyword not in known:
            known[rule.keyword] = not gated or rule.keyword in line
        if known[rule.keyword]:
            for m in pattern.finditer(line):
                at.append(m.start())
                hits.append((rule, m[0].count(b" ")))
    if not at:
        return []
    starts = (np.searchsorted(spaces_of(line), at) - 1).tolist()
    found = sorted(((-rule.priority, -spaces, start, rule) for start, (rule, spaces) in zip(starts, hits, strict=True)), key=lambda x: (*x[:3], x[3].name))
    furthest: dict[int, int] = {}  # by start of a kept interval
    out = []
    for _, spaces, start, rule in found:
        end = start + 1 - spaces
        if not any(furthest.get(a, 0) >= end for a in range(start, start - LONGEST, -1)):
            furthest[start] = max(end, furthest.get(start, 0))
            out.append((rule.name, rule.label, start, end, rule.confidence))
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    detection = T.StructType([T.StructField("rule", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("confidence", T.DoubleType())])
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("detections", T.ArrayType(detection)),
    ])
    arrow_detection = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = worker_state("license-rules", _compiled)
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for text in batch.column(1):
                words = fold(text.as_py())
                line = b" " + b" ".join(words) + b" "
                base = base_places(line) if b" license " in line else []
                found = detect(line, rules)
                labels = {label for _, label in base}
                miss = 1.0
                for d in found:
                    miss *= 1.0 - d[4]
                score = round(1.0 - miss, 9)
                row = (
                    len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)),
                    ",".join(sorted(labels | {d[1] for d in found})), max(score, 0.8 if base else 0.0), [dict(zip(("rule", "label", "start", "end", "confidence"), d, strict=True)) for d in found],
                )
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), arrow_detection]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("detections")


QUERIES = {"op9_licenses": op9_licenses}
