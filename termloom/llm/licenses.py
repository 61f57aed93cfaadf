"""License scans: ordered signature rules over the words of a text.

A rule is a regular expression over the words (A-Z lower-cased, joined by one space), written for one license:
its name in a notice, behind an SPDX tag or by itself, its address, or a sentence of its text. Rules are tried
only on texts that hold all of the rule's keywords, words that every match has. Detections are taken by priority,
then length; one that lies inside the words of a taken one is suppressed. Base phrases are never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import give_back, pieces


class Rule(NamedTuple):
    label: str
    name: str
    pattern: re.Pattern[bytes]
    keywords: frozenset[str]
    priority: int  # smaller comes first
    weight: float
    base: bool = False


# Fixed values of the contract: base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# label; the words of its SPDX tag (empty: none); its name as a regular expression; keywords of the name
NAMES = (
    ("mit", "mit", r"mit (?:x11 )?licen[cs]e|x11 mit", "mit"),
    ("mit-0", "mit 0", r"mit no attribution|mit 0 licen[cs]e", "mit"),
    ("x11", "x11", r"x11 licen[cs]e|x consortium licen[cs]e", ""),
    ("expat", "", r"expat licen[cs]e", "expat"),
    ("isc", "isc", r"isc licen[cs]e", "isc"),
    ("0bsd", "0bsd", r"zero clause bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?", "zero"),
    ("bsd-1-clause", "bsd 1 clause", r"bsd 1 clause(?: licen[cs]e)?|1 clause bsd(?: licen[cs]e)?", "bsd"),
    ("bsd-2-clause", "bsd 2 clause", r"(?:simplified |freebsd |2 clause )bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?|freebsd licen[cs]e", ""),
    ("bsd-3-clause", "bsd 3 clause", r"(?:new |revised |modified |3 clause )bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?", "bsd"),
    ("bsd-4-clause", "bsd 4 clause", r"(?:original |4 clause )bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?", "bsd"),
    ("bsd", "", r"bsd(?: style)? licen[cs]e", "bsd"),
    ("apache-1.0", "apache 1 0", r"apache (?:software )?licen[cs]e (?:version |v)?1 0", "apache"),
    ("apache-1.1", "apache 1 1", r"apache (?:software )?licen[cs]e (?:version |v)?1 1", "apache"),
    ("apache-2", "apache 2 0", r"apache (?:software )?licen[cs]e (?:version )?v?2(?: 0)?|apache 2(?: 0)? licen[cs]e", "apache"),
    ("apache", "", r"apache (?:software )?licen[cs]e", "apache"),
    ("gpl-1.0", "gpl 1 0(?: only)?", r"(?:gnu )?(?:general public licen[cs]e|gpl) (?:version )?v?1(?: 0)?", ""),
    ("gpl-2.0", "gpl 2 0(?: only)?", r"(?:gnu )?(?:general public licen[cs]e|gpl) (?:version )?v?2(?: 0)?|gplv2", ""),
    ("gpl-3.0", "gpl 3 0(?: only)?", r"(?:gnu )?(?:general public licen[cs]e|gpl) (?:version )?v?3(?: 0)?|gplv3", ""),
    ("gpl-2.0-or-later", "gpl 2 0 or later", r"(?:gnu )?(?:general public licen[cs]e|gpl) (?:version )?v?2(?: 0)? or (?:at your option )?any later(?: version)?|gplv2 or later", ""),
    ("gpl-3.0-or-later", "gpl 3 0 or later", r"(?:gnu )?(?:general public licen[cs]e|gpl) (?:version )?v?3(?: 0)? or (?:at your option )?any later(?: version)?|gplv3 or later", ""),
    ("gpl", "", r"gnu (?:general public licen[cs]e|gpl)", "gnu"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", r"(?:gnu library general public licen[cs]e|(?:gnu )?lgpl) (?:version )?v?2(?: 0)?", ""),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", r"(?:gnu lesser general public licen[cs]e|(?:gnu )?lgpl) (?:version )?v?2 1", ""),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", r"(?:gnu lesser general public licen[cs]e|(?:gnu )?lgpl) (?:version )?v?3(?: 0)?|lgplv3", ""),
    ("lgpl", "", r"gnu (?:lesser|library) general public licen[cs]e|gnu lgpl", "gnu"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", r"(?:gnu )?(?:affero general public licen[cs]e|agpl) (?:version )?v?3(?: 0)?|agplv3", ""),
    ("agpl", "", r"gnu (?:affero general public licen[cs]e|agpl)", "gnu"),
    ("gfdl-1.1", "gfdl 1 1(?: only| or later)?", r"gnu free documentation licen[cs]e (?:version )?v?1 1", "gnu documentation"),
    ("gfdl-1.2", "gfdl 1 2(?: only| or later)?", r"gnu free documentation licen[cs]e (?:version )?v?1 2", "gnu documentation"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?", r"gnu free documentation licen[cs]e (?:version )?v?1 3", "gnu documentation"),
    ("gfdl", "", r"gnu free documentation licen[cs]e", "gnu documentation"),
    ("mpl-1.0", "mpl 1 0", r"mozilla public licen[cs]e (?:version )?v?1 0", "mozilla public"),
    ("mpl-1.1", "mpl 1 1", r"mozilla public licen[cs]e (?:version )?v?1 1", "mozilla public"),
    ("mpl-2.0", "mpl 2 0", r"mozilla public licen[cs]e (?:version )?v?2(?: 0)?", "mozilla public"),
    ("mpl", "", r"mozilla public licen[cs]e", "mozilla public"),
    ("epl-1.0", "epl 1 0", r"eclipse public licen[cs]e (?:version )?v?1 0", "eclipse public"),
    ("epl-2.0", "epl 2 0", r"eclipse public licen[cs]e (?:version )?v?2(?: 0)?", "eclipse public"),
    ("epl", "", r"eclipse public licen[cs]e", "eclipse public"),
    ("cddl-1.0", "cddl 1 0", r"common development and distribution licen[cs]e (?:version )?v?1 0", "common development"),
    ("cddl-1.1", "cddl 1 1", r"common development and distribution licen[cs]e (?:version )?v?1 1", "common development"),
    ("cddl", "", r"common development and distribution licen[cs]e", "common development"),
    ("cpl-1.0", "cpl 1 0", r"common public licen[cs]e(?: (?:version )?v?1 0)?", "common public"),
    ("cpal-1.0", "cpal 1 0", r"common public attribution licen[cs]e(?: (?:version )?v?1 0)?", "common public attribution"),
    ("ibm-pl-1.0", "ipl 1 0", r"ibm public licen[cs]e(?: (?:version )?v?1 0)?", "ibm public"),
    ("eupl-1.1", "eupl 1 1", r"european union public licen[cs]e (?:version )?v?1 1", "european union"),
    ("eupl-1.2", "eupl 1 2", r"european union public licen[cs]e (?:version )?v?1 2", "european union"),
    ("eupl", "", r"european union public licen[cs]e", "european union"),
    ("osl-3.0", "osl 3 0", r"open software licen[cs]e(?: (?:version )?v?3 0)?", "open software"),
    ("afl-3.0", "afl 3 0", r"academic free licen[cs]e(?: (?:version )?v?3 0)?", "academic free"),
    ("artistic-1.0", "artistic 1 0", r"artistic licen[cs]e (?:version )?v?1 0", "artistic"),
    ("artistic-2.0", "artistic 2 0", r"artistic licen[cs]e (?:version )?v?2(?: 0)?", "artistic"),
    ("artistic", "", r"artistic licen[cs]e", "artistic"),
    ("bsl-1.0", "bsl 1 0", r"boost software licen[cs]e(?: (?:version )?v?1 0)?", "boost software"),
    ("busl-1.1", "busl 1 1", r"business source licen[cs]e(?: (?:version )?v?1 1)?", "business source"),
    ("sspl-1.0", "sspl 1 0", r"server side public licen[cs]e(?: (?:version )?v?1)?", "server side public"),
    ("elastic-2.0", "elastic 2 0", r"elastic licen[cs]e(?: (?:version )?v?2(?: 0)?)?", "elastic"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("libpng", "libpng", r"libpng licen[cs]e", "libpng"),
    ("openssl", "openssl", r"openssl licen[cs]e", "openssl"),
    ("curl", "curl", r"curl licen[cs]e", "curl"),
    ("python-2.0", "(?:python|psf) 2 0", r"python (?:software foundation )?licen[cs]e(?: (?:version )?v?2(?: 0)?)?|psf licen[cs]e", ""),
    ("php-3.01", "php 3 01", r"php licen[cs]e(?: (?:version )?v?3 01)?", "php"),
    ("ruby", "ruby", r"ruby licen[cs]e", "ruby"),
    ("w3c", "w3c", r"w3c (?:software (?:notice and )?)?licen[cs]e", "w3c"),
    ("unicode", "unicode dfs 2016", r"unicode (?:data files and software )?licen[cs]e(?: agreement)?", "unicode"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[cs]e", "ncsa"),
    ("upl-1.0", "upl 1 0", r"universal permissive licen[cs]e(?: (?:version )?v?1 0)?", "universal permissive"),
    ("ms-pl", "ms pl", r"microsoft public licen[cs]e", "microsoft public"),
    ("ms-rl", "ms rl", r"microsoft reciprocal licen[cs]e", "microsoft reciprocal"),
    ("wtfpl", "wtfpl", r"wtfpl|do what the fuck you want to public licen[cs]e", ""),
    ("unlicense", "unlicense", r"the unlicense", "unlicense"),
    ("beerware", "beerware", r"beer ?ware licen[cs]e", ""),
    ("ofl-1.1", "ofl 1 1", r"sil open font licen[cs]e(?: (?:version )?v?1 1)?|open font licen[cs]e", "open font"),
    ("ubuntu-font-1.0", "ubuntu font 1 0", r"ubuntu font licen[cs]e(?: (?:version )?v?1 0)?", "ubuntu font"),
    ("odbl-1.0", "odbl 1 0", r"open (?:data commons open )?database licen[cs]e(?: (?:version )?v?1 0)?|odbl", ""),
    ("odc-by-1.0", "odc by 1 0", r"open data commons attribution licen[cs]e(?: (?:version )?v?1 0)?", "commons attribution"),
    ("pddl-1.0", "pddl 1 0", r"public domain dedication and licen[cs]e|pddl", ""),
    ("cdla-permissive-2.0", "cdla permissive (?:1|2) 0", r"community data licen[cs]e agreement permissive(?: (?:version )?v?(?:1|2) 0)?", "community data"),
    ("cdla-sharing-1.0", "cdla sharing 1 0", r"community data licen[cs]e agreement sharing(?: (?:version )?v?1 0)?", "community data"),
    ("ogl-uk-3.0", "ogl uk 3 0", r"open government licen[cs]e(?: (?:version )?v?3 0)?", "open government"),
    ("cc0-1.0", "cc0 1 0", r"cc0(?: 1 0(?: universal)?)?|creative commons zero", ""),
    ("cc-by-nc-nd", r"cc by nc nd(?: \d 0)?", r"cc by nc nd(?: \d \d)?|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: \d \d)?", ""),
    ("cc-by-nc-sa", r"cc by nc sa(?: \d 0)?", r"cc by nc sa(?: \d \d)?|creative commons attribution non ?commercial share ?alike(?: \d \d)?", ""),
    ("cc-by-nc", r"cc by nc(?: \d 0)?", r"cc by nc(?: \d \d)?|creative commons attribution non ?commercial(?: \d \d)?", ""),
    ("cc-by-nd", r"cc by nd(?: \d 0)?", r"cc by nd(?: \d \d)?|creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: \d \d)?", ""),
    ("cc-by-sa", r"cc by sa(?: \d 0)?", r"cc by sa(?: \d \d)?|creative commons attribution share ?alike(?: \d \d)?", ""),
    ("cc-by", r"cc by(?: \d 0)?", r"cc by \d \d|creative commons attribution(?: \d \d)?", ""),
    ("cc", "", r"creative commons licen[cs]e", "creative commons"),
    ("openrail-m", "", r"(?:bigscience |creativeml )?open ?rail(?: m| \+\+ m)? licen[cs]e", ""),
    ("gfsl", "", r"functional source licen[cs]e", "functional source"),
    ("polyform-nc-1.0", "polyform noncommercial 1 0 0", r"polyform noncommercial licen[cs]e", "polyform"),
)

# how a name stands in a text: kind, pattern around the name, keywords of its own, priority, weight
FORMS = (
    ("notice", r"(?:dual |multi )?(?:licen[cs]ed|released|distributed|published|available|provided|covered|offered|shared|reproduced) (?:to \w+ )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?(?:{name})(?: international| unported| universal)?(?: public)?(?: licen[cs]e)?", "under", 1, 0.95),
    ("governed", r"(?:subject to|governed by|pursuant to|in accordance with|compliance with|terms of) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})", "", 2, 0.85),
    ("name", r"(?:{name})", "", 4, 0.6),
)
SPDX = ("spdx", r"spdx licen[cs]e identifier (?:{name})", "spdx identifier", 0, 1.0)

# label, an address (as words, behind any scheme), keywords
ADDRESSES = (
    ("mit", r"opensource org licenses mit(?: license(?: php)?)?", "opensource mit"),
    ("apache-2", r"apache org licenses(?: license 2 0(?: txt| html)?)?", "apache licenses"),
    ("gpl-2.0", r"gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?", "gnu licenses gpl"),
    ("gpl-3.0", r"gnu org licenses gpl 3 0(?: html| txt)?", "gnu licenses gpl"),
    ("gpl", r"gnu org licenses gpl(?: html| txt)?", "gnu licenses gpl"),
    ("lgpl", r"gnu org licenses lgpl(?: \d \d)?(?: html| txt)?", "gnu licenses lgpl"),
    ("agpl-3.0", r"gnu org licenses agpl(?: 3 0)?(?: html| txt)?", "gnu licenses agpl"),
    ("gfdl", r"gnu org licenses fdl(?: \d \d)?(?: html| txt)?", "gnu licenses fdl"),
    ("mpl-2.0", r"mozilla org (?:en us )?mpl(?: 2 0)?", "mozilla mpl"),
    ("epl-1.0", r"eclipse org legal epl v10(?: html)?", "eclipse epl"),
    ("epl-2.0", r"eclipse org legal epl (?:v20|2 0)(?: html)?", "eclipse epl"),
    ("bsl-1.0", r"boost org license 1 0(?: txt)?", "boost"),
    ("unlicense", r"unlicense org", "unlicense"),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", "creativecommons publicdomain"),
    ("cc-by", r"creativecommons org licenses by \d \d", "creativecommons"),
    ("cc-by-sa", r"creativecommons org licenses by sa \d \d", "creativecommons"),
    ("cc-by-nc", r"creativecommons org licenses by nc \d \d", "creativecommons"),
    ("cc-by-nd", r"creativecommons org licenses by nd \d \d", "creativecommons"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa \d \d", "creativecommons"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd \d \d", "creativecommons"),
    ("odbl-1.0", r"opendatacommons org licenses odbl(?: 1 0)?", "opendatacommons"),
    ("ofl-1.1", r"scripts sil org ofl", "sil ofl"),
)

# label, a sentence of the license's own text, keywords
SENTENCES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted software"),
    ("isc", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", "hereby granted software"),
    ("bsd", r"redistributions? and use in source and binary forms with or without modification are permitted provided that", "binary forms modification"),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice", "redistributions binary reproduce"),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products derived from this software", "neither endorse promote"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising materials"),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless applicable basis"),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute gnu foundation"),
    ("gpl-2.0-or-later", r"gnu general public license as published by the free software foundation (?:either )?version 2 (?:of the license )?or (?:at your option )?any later version", "gnu foundation later"),
    ("gpl-3.0-or-later", r"gnu general public license as published by the free software foundation (?:either )?version 3 (?:of the license )?or (?:at your option )?any later version", "gnu foundation later"),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license", "redistribute gnu lesser"),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public license", "redistribute gnu affero"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "granted gnu documentation"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "source mozilla"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying eclipse"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "software warranty liable"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "hereby organization software"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "retain notice whatever"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", "font sil"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", "permission documentation fee"),
    ("ncsa", r"permission is hereby granted free of charge to any person obtaining a copy of this software .{0,80} to deal with the software without restriction", "hereby granted deal"),
    ("public-domain", r"(?:is|are|been|was) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("public-domain", r"no copyright is claimed", "copyright claimed"),
    ("proprietary", r"all rights (?:are )?reserved", "rights reserved"),
    ("proprietary", r"(?:no part of this|may not be) (?:\w+ ){0,6}(?:reproduced|copied|distributed) (?:\w+ ){0,12}without (?:the )?(?:prior |express )*(?:written )?(?:permission|consent)", "without"),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)(?: information)?", "confidential proprietary"),
    ("non-commercial", r"for (?:personal (?:and |or ))?non ?commercial (?:use|purposes)(?: only)?", "for"),
    ("research-only", r"for (?:academic |scientific )?research (?:use|purposes) only", "research only"),
)


def _rule(label: str, name: str, pattern: str, keywords: str, priority: int, weight: float, base: bool = False) -> Rule:
    whole = re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")
    return Rule(label, name, whole, frozenset(keywords.split()), priority, weight, base)


def all_rules() -> tuple[Rule, ...]:
    """The rules in their order, some hundreds: every name in every form, then addresses and sentences."""
    out = [_rule(label, f"base:{label}", phrase, phrase, 0, 0.9, True) for phrase, label in BASE]
    for label, tag, name, keys in NAMES:
        for form, around, own, priority, weight in FORMS:
            out.append(_rule(label, f"{form}:{label}", around.replace("{name}", name), f"{own} {keys}", priority, weight))
        if tag:
            form, around, own, priority, weight = SPDX
            out.append(_rule(label, f"{form}:{label}", around.replace("{name}", tag), own, priority, weight))
    out += [_rule(label, f"address:{label}", r"(?:https? )?(?:www )?" + p, keys, 1, 0.9) for label, p, keys in ADDRESSES]
    out += [_rule(label, f"sentence:{label}", p, keys, 3 if label in ("proprietary", "non-commercial", "research-only") else 1, 0.5 if label == "proprietary" else 0.9) for label, p, keys in SENTENCES]
    return tuple(out)


# One of these words is in every match of a rule whose keywords alone are too common or missing.
ANCHORS = ("license licence unlicense spdx gpl gplv2 gplv3 lgpl lgplv3 agpl agplv3 x11 zero freebsd bsd odbl pddl cc0 cc creative creativecommons "
           "opendatacommons opensource wtfpl psf beerware openrail licenses org hereby gnu mozilla rights copied reproduced distributed commercial noncommercial "
           "research confidential domain copyright binary redistributions neither advertising unless accompanying warranty unencumbered retain font permission mit")
_SPACES = bytes.maketrans(
    bytes(b for b in range(128) if not chr(b).isalnum()) + bytes(range(65, 91)),
    b" " * sum(not chr(b).isalnum() for b in range(128)) + bytes(range(97, 123)),
)


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, parted by every ASCII character that is no letter or digit."""
    return text.encode().translate(_SPACES).split()


class Detection(NamedTuple):
    label: str
    rule: str
    start: int
    end: int
    weight: float
    base: bool


def settle(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Of (start, end, number of the rule, rule) those that no taken one holds, by start; base ones all stay."""
    taken: list[tuple[int, int, Rule]] = []
    for a, b, _, rule in sorted(found, key=lambda x: (x[3].priority, x[0] - x[1], x[0], x[2])):
        if rule.base or not any(x <= a and b <= y for x, y, _ in taken):
            taken.append((a, b, rule))
    return sorted(taken, key=lambda x: (x[0], x[1], x[2].name))


class Scanner:
    """The rules by keyword; one is made per task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.keys = frozenset(k.encode() for r in rules for k in r.keywords) | frozenset(ANCHORS.encode().split())
        self.anchors = frozenset(ANCHORS.encode().split())
        self.needs = [frozenset(k.encode() for k in r.keywords) for r in rules]

    def scan(self, words: list[bytes]) -> list[Detection]:
        """Detections of a text, word numbers from 0, end exclusive."""
        have = self.keys.intersection(words)
        if not have & self.anchors:
            return []
        flat = b" " + b" ".join(words) + b" "
        found = []
        for no, (rule, need) in enumerate(zip(self.rules, self.needs, strict=True)):
            if need <= have:
                found += [(*m.span(), no, rule) for m in rule.pattern.finditer(flat)]
        return [Detection(r.label, r.name, flat.count(b" ", 0, a) - 1, flat.count(b" ", 0, b), r.weight, r.base) for a, b, r in settle(found)]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words and found (label, rule, start, end in words, weight, base; by start) of every row.

    A null or empty text has no words and finds nothing. Rows that repeat a key or are equal are rows of their own; texts
    of any length are taken whole; an empty table gives no row; other columns are ignored.
    """
    item = "struct<label:string,rule:string,start:long,end:long,weight:double,base:boolean>"
    kinds = pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(all_rules())
        for b in pieces(batches):
            n, found = [], []
            for t in b.column(1).to_pylist():
                words = words_of(t or "")
                n.append(len(words))
                found.append([d._asdict() for d in scanner.scan(words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(kinds))], ["key", "n_words", "found"])
        give_back()

    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, n_words long, found array<{item}>").withColumnRenamed("key", key)
