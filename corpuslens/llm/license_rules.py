"""Signatures of licenses: a label, a kind and a regex over lower-case words, a line each.

A word is written as it is; one blank stands for whatever stands between two words.
Kinds, by priority: tag (an identifier's tag), text (a sentence of the license itself),
notice (a statement that it applies), name (its name with version, or its address),
short (a name that leaves the version open).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

KINDS = {"short": (1, 0.7), "name": (2, 0.85), "notice": (3, 0.95), "text": (4, 0.98), "tag": (5, 1.0)}

SIGNATURES = r"""
mit tag spdx license identifier mit
mit text permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit text the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit notice (is |are )?(released|licensed|distributed|available|published|provided) under (the )?(terms of the )?(mit|expat) licen[sc]e
mit notice licen[sc]e mit
mit notice (this|the) (project|software|code|library|program|package) uses the mit licen[sc]e
mit name (https? )?(www )?opensource org licenses mit( license)?( php| html)?
mit name (https? )?choosealicense com licenses mit
mit short (the )?mit licen[sc]e
mit short (the )?expat licen[sc]e
mit short mit x11 licen[sc]e
mit-0 tag spdx license identifier mit 0
mit-0 name mit no attribution( licen[sc]e)?
x11 tag spdx license identifier x11
x11 short (the )?x11 licen[sc]e
isc tag spdx license identifier isc
isc text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc notice (released|licensed|distributed|available) under (the )?(terms of the )?isc licen[sc]e
isc name (https? )?(www )?opensource org licenses isc( license)?( txt)?
isc short (the )?isc licen[sc]e
apache-2.0 tag spdx license identifier apache 2 0
apache-2.0 text unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 text each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 notice (released|licensed|distributed|available|provided) under (the )?(terms of the )?apache (software )?licen[sc]e (version |v)?2( 0)?
apache-2.0 notice (released|licensed|distributed|available|provided) under (the )?apache 2( 0)?( licen[sc]e)?
apache-2.0 notice you may not use this file except in compliance with the license
apache-2.0 name apache (software )?licen[sc]e (version |v)?2( 0)?
apache-2.0 name apache (software )?licen[sc]e v2( 0)?
apache-2.0 name apache (2|v2)( 0)? licen[sc]e
apache-2.0 name (https? )?(www )?apache org licenses license 2 0( txt| html)?
apache-2.0 name (https? )?(www )?opensource org licenses apache 2 0
apache-1.1 tag spdx license identifier apache 1 1
apache-1.1 name apache (software )?licen[sc]e (version |v)?1 1
apache-1.1 text this product includes software developed by the apache software foundation
apache-1.0 tag spdx license identifier apache 1 0
apache-1.0 name apache (software )?licen[sc]e (version |v)?1 0
apache short (the )?apache (software )?licen[sc]e
gpl-1.0 tag spdx license identifier gpl 1 0( only| or later)?
gpl-1.0 name (gnu )?general public licen[sc]e (version |v)?1( 0)?
gpl-2.0 tag spdx license identifier gpl 2 0( only)?
gpl-2.0-or-later tag spdx license identifier gpl 2 0 or later
gpl-2.0 text this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2
gpl-2.0-or-later text under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (at your option )?any later version
gpl-2.0 notice (released|licensed|distributed|available) under (the )?(terms of the )?(gnu )?general public licen[sc]e (version |v)?2( 0)?
gpl-2.0 notice (released|licensed|distributed|available) under (the )?(terms of the )?(gnu )?gpl ?v?2( 0)?
gpl-2.0 notice under the terms of version 2 of the gnu general public licen[sc]e
gpl-2.0 name (gnu )?general public licen[sc]e (version |v)?2( 0)?
gpl-2.0 name (gnu )?gpl (version |v)?2( 0)?( only)?
gpl-2.0 name (gnu )?gplv2( only)?
gpl-2.0-or-later name (gnu )?gpl ?v?2( 0)? or later
gpl-2.0 name (https? )?(www )?gnu org licenses (old licenses )?gpl 2 0( html| txt)?
gpl-3.0 tag spdx license identifier gpl 3 0( only)?
gpl-3.0-or-later tag spdx license identifier gpl 3 0 or later
gpl-3.0-or-later text under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version
gpl-3.0 text the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0 notice (released|licensed|distributed|available) under (the )?(terms of the )?(gnu )?general public licen[sc]e (version |v)?3( 0)?
gpl-3.0 notice (released|licensed|distributed|available) under (the )?(terms of the )?(gnu )?gpl ?v?3( 0)?
gpl-3.0 notice under the terms of version 3 of the gnu general public licen[sc]e
gpl-3.0 name (gnu )?general public licen[sc]e (version |v)?3( 0)?
gpl-3.0 name (gnu )?gpl (version |v)?3( 0)?( only)?
gpl-3.0 name (gnu )?gplv3( only)?
gpl-3.0-or-later name (gnu )?gpl ?v?3( 0)? or later
gpl-3.0 name (https? )?(www )?gnu org licenses gpl 3 0( html| txt)?
gpl notice you should have received a copy of the gnu general public license along with this program
gpl notice (released|licensed|distributed|available) under (the )?(terms of the )?gnu gpl
gpl short (the )?gnu general public licen[sc]e
gpl short (the )?general public licen[sc]e
gpl short (the )?gnu gpl
gpl short (the )?gpl licen[sc]e
gpl name (https? )?(www )?gnu org licenses gpl( html| txt)?
lgpl-2.0 tag spdx license identifier lgpl 2 0( only| or later)?
lgpl-2.0 name (gnu )?library general public licen[sc]e (version |v)?2( 0)?
lgpl-2.1 tag spdx license identifier lgpl 2 1( only)?
lgpl-2.1-or-later tag spdx license identifier lgpl 2 1 or later
lgpl-2.1 name (gnu )?lesser general public licen[sc]e (version |v)?2 1
lgpl-2.1 name (gnu )?lgpl ?v?2 1
lgpl-2.1 name (https? )?(www )?gnu org licenses (old licenses )?lgpl 2 1( html| txt)?
lgpl-3.0 tag spdx license identifier lgpl 3 0( only)?
lgpl-3.0-or-later tag spdx license identifier lgpl 3 0 or later
lgpl-3.0 name (gnu )?lesser general public licen[sc]e (version |v)?3( 0)?
lgpl-3.0 name (gnu )?lgpl ?v?3( 0)?
lgpl-3.0 name (https? )?(www )?gnu org licenses lgpl 3 0( html| txt)?
lgpl text this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license
lgpl notice (released|licensed|distributed|available) under (the )?(terms of the )?(gnu )?lgpl
lgpl notice (released|licensed|distributed|available) under (the )?(terms of the )?(gnu )?(lesser|library) general public licen[sc]e
lgpl short (the )?(gnu )?lesser general public licen[sc]e
lgpl short (the )?(gnu )?library general public licen[sc]e
lgpl short (the )?gnu lgpl
lgpl short (the )?lgpl licen[sc]e
agpl-1.0 tag spdx license identifier agpl 1 0( only| or later)?
agpl-1.0 name affero general public licen[sc]e (version |v)?1( 0)?
agpl-3.0 tag spdx license identifier agpl 3 0( only)?
agpl-3.0-or-later tag spdx license identifier agpl 3 0 or later
agpl-3.0 name (gnu )?affero general public licen[sc]e (version |v)?3( 0)?
agpl-3.0 name (gnu )?agpl ?v?3( 0)?
agpl-3.0 name (https? )?(www )?gnu org licenses agpl 3 0( html| txt)?
agpl text under the terms of the gnu affero general public license as published by the free software foundation
agpl short (the )?(gnu )?affero general public licen[sc]e
agpl short (the )?gnu agpl
agpl short (the )?agpl licen[sc]e
gfdl-1.1 tag spdx license identifier gfdl 1 1( only| or later)?
gfdl-1.2 tag spdx license identifier gfdl 1 2( only| or later)?
gfdl-1.3 tag spdx license identifier gfdl 1 3( only| or later)?
gfdl-1.2 name (gnu )?free documentation licen[sc]e (version |v)?1 2
gfdl-1.3 name (gnu )?free documentation licen[sc]e (version |v)?1 3
gfdl text permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl short (the )?(gnu )?free documentation licen[sc]e
0bsd tag spdx license identifier 0bsd
0bsd name (zero clause|0 clause) bsd( licen[sc]e)?
0bsd name bsd zero clause licen[sc]e
bsd-1-clause tag spdx license identifier bsd 1 clause
bsd-1-clause name bsd 1 clause( licen[sc]e)?
bsd-2-clause tag spdx license identifier bsd 2 clause
bsd-2-clause notice (released|licensed|distributed|available) under (the )?(terms of the )?(bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[sc]e
bsd-2-clause name bsd (2|two) clause( licen[sc]e)?
bsd-2-clause name (2|two) clause bsd( licen[sc]e)?
bsd-2-clause name simplified bsd licen[sc]e
bsd-2-clause name freebsd licen[sc]e
bsd-2-clause name (https? )?(www )?opensource org licenses bsd 2 clause
bsd-3-clause tag spdx license identifier bsd 3 clause
bsd-3-clause text neither the name of [a-z0-9]+( [a-z0-9]+)? nor the names of its contributors may be used to endorse or promote products
bsd-3-clause notice (released|licensed|distributed|available) under (the )?(terms of the )?(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e
bsd-3-clause name bsd (3|three) clause( licen[sc]e)?
bsd-3-clause name (3|three) clause bsd( licen[sc]e)?
bsd-3-clause name new bsd licen[sc]e
bsd-3-clause name modified bsd licen[sc]e
bsd-3-clause name revised bsd licen[sc]e
bsd-3-clause name (https? )?(www )?opensource org licenses bsd 3 clause
bsd-4-clause tag spdx license identifier bsd 4 clause
bsd-4-clause text all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause name bsd (4|four) clause( licen[sc]e)?
bsd-4-clause name (4|four) clause bsd( licen[sc]e)?
bsd-4-clause name original bsd licen[sc]e
bsd text redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd notice use of this source code is governed by a bsd style licen[sc]e
bsd notice (released|licensed|distributed|available) under (the )?(terms of the )?bsd licen[sc]e
bsd short (the )?bsd licen[sc]e
bsd short bsd style licen[sc]e
bsd short berkeley software distribution licen[sc]e
mpl-1.0 tag spdx license identifier mpl 1 0
mpl-1.0 name mozilla public licen[sc]e (version |v)?1 0
mpl-1.1 tag spdx license identifier mpl 1 1
mpl-1.1 name mozilla public licen[sc]e (version |v)?1 1
mpl-2.0 tag spdx license identifier mpl 2 0( no copyleft exception)?
mpl-2.0 text this source code form is subject to the terms of the mozilla public license (version |v )?2 0
mpl-2.0 notice (released|licensed|distributed|available) under (the )?(terms of the )?mozilla public licen[sc]e (version |v)?2( 0)?
mpl-2.0 notice (released|licensed|distributed|available) under (the )?(terms of the )?mpl ?v?2( 0)?
mpl-2.0 name mozilla public licen[sc]e (version |v)?2( 0)?
mpl-2.0 name (https? )?(www )?mozilla org (en us )?mpl 2 0
mpl short (the )?mozilla public licen[sc]e
epl-1.0 tag spdx license identifier epl 1 0
epl-1.0 name eclipse public licen[sc]e (version |v )?1( 0)?
epl-2.0 tag spdx license identifier epl 2 0
epl-2.0 name eclipse public licen[sc]e (version |v )?2( 0)?
epl-2.0 name (https? )?(www )?eclipse org legal epl 2 0
epl short (the )?eclipse public licen[sc]e
edl-1.0 name eclipse distribution licen[sc]e (version |v )?1( 0)?
cpl-1.0 tag spdx license identifier cpl 1 0
cpl-1.0 name common public licen[sc]e (version )?1 0
cddl-1.0 tag spdx license identifier cddl 1 0
cddl-1.0 name common development and distribution licen[sc]e (version )?1 0
cddl-1.1 tag spdx license identifier cddl 1 1
cddl-1.1 name common development and distribution licen[sc]e (version )?1 1
cddl short common development and distribution licen[sc]e
eupl-1.1 tag spdx license identifier eupl 1 1
eupl-1.1 name european union public licen[sc]e (version |v )?1 1
eupl-1.2 tag spdx license identifier eupl 1 2
eupl-1.2 name european union public licen[sc]e (version |v )?1 2
eupl short european union public licen[sc]e
bsl-1.0 tag spdx license identifier bsl 1 0
bsl-1.0 text permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0 name boost software licen[sc]e( version)?( 1 0)?
bsl-1.0 name (https? )?(www )?boost org license 1 0( txt)?
zlib tag spdx license identifier zlib
zlib text this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib short (the )?zlib licen[sc]e
libpng-2.0 tag spdx license identifier libpng 2 0
libpng-2.0 short (the )?libpng licen[sc]e
unlicense tag spdx license identifier unlicense
unlicense text this is free and unencumbered software released into the public domain
unlicense name (https? )?unlicense org
unlicense short the unlicense
wtfpl tag spdx license identifier wtfpl
wtfpl name do what the fuck you want to public licen[sc]e
artistic-1.0 tag spdx license identifier artistic 1 0( perl| cl8)?
artistic-1.0 name artistic licen[sc]e (version )?1 0
artistic-2.0 tag spdx license identifier artistic 2 0
artistic-2.0 name artistic licen[sc]e (version )?2 0
artistic notice (under )?the same terms as perl itself
artistic short (the )?artistic licen[sc]e
python-2.0 tag spdx license identifier (python|psf) 2 0
python-2.0 name (python software foundation|psf) licen[sc]e( agreement)?( version)?( 2)?
python-2.0 short python software foundation licen[sc]e
postgresql tag spdx license identifier postgresql
postgresql short (the )?postgresql licen[sc]e
ncsa tag spdx license identifier ncsa
ncsa name university of illinois ncsa open source licen[sc]e
upl-1.0 tag spdx license identifier upl 1 0
upl-1.0 name universal permissive licen[sc]e( version| v)?( 1 0)?
ms-pl tag spdx license identifier ms pl
ms-pl name microsoft public licen[sc]e
ms-rl tag spdx license identifier ms rl
ms-rl name microsoft reciprocal licen[sc]e
ofl-1.1 tag spdx license identifier ofl 1 1
ofl-1.1 name sil open font licen[sc]e( version)?( 1 1)?
ofl-1.1 notice this font software is licensed under the sil open font licen[sc]e
osl-3.0 tag spdx license identifier osl 3 0
osl-3.0 name open software licen[sc]e (version |v )?3 0
afl-3.0 tag spdx license identifier afl 3 0
afl-3.0 name academic free licen[sc]e (version |v )?3 0
odbl-1.0 tag spdx license identifier odbl 1 0
odbl-1.0 name open database licen[sc]e( version| v)?( 1 0)?
odc-by-1.0 tag spdx license identifier odc by 1 0
odc-by-1.0 name open data commons attribution licen[sc]e( version| v)?( 1 0)?
pddl-1.0 tag spdx license identifier pddl 1 0
pddl-1.0 name public domain dedication and licen[sc]e
cc0-1.0 tag spdx license identifier cc0 1 0
cc0-1.0 notice (released|licensed|dedicated|available) (under|to) (the )?(creative commons )?cc0( 1 0)?
cc0-1.0 name (creative commons )?cc0 1 0( universal)?
cc0-1.0 name (https? )?creativecommons org publicdomain zero 1 0
cc0-1.0 short creative commons (cc0|zero)
cc-by-4.0 notice licensed under (a )?(the )?(creative commons attribution|cc by) 4 0( international)?( licen[sc]e)?
cc-by-sa-4.0 notice licensed under (a )?(the )?(creative commons attribution share ?alike|cc by sa) 4 0( international)?( licen[sc]e)?
cc-by-nd-4.0 notice licensed under (a )?(the )?(creative commons attribution no ?derivatives|cc by nd) 4 0( international)?( licen[sc]e)?
cc-by-nc-4.0 notice licensed under (a )?(the )?(creative commons attribution non ?commercial|cc by nc) 4 0( international)?( licen[sc]e)?
cc-by-nc-sa-4.0 notice licensed under (a )?(the )?(creative commons attribution non ?commercial share ?alike|cc by nc sa) 4 0( international)?( licen[sc]e)?
cc-by-nc-nd-4.0 notice licensed under (a )?(the )?(creative commons attribution non ?commercial no ?derivatives|cc by nc nd) 4 0( international)?( licen[sc]e)?
cc short (a )?creative commons licen[sc]e
cc short (a )?creative commons attribution licen[sc]e
public-domain notice (is |are )?(released|dedicated|placed) (in|into|to) the public domain
public-domain notice this (work|file|software|code|text) is in the public domain
proprietary notice all rights reserved
proprietary notice proprietary and confidential
proprietary notice unauthorized copying of this (file|software|document) via any medium is strictly prohibited
proprietary short proprietary licen[sc]e
proprietary short commercial licen[sc]e
proprietary short end user licen[sc]e agreement
sspl-1.0 tag spdx license identifier sspl 1 0
sspl-1.0 name server side public licen[sc]e
busl-1.1 tag spdx license identifier busl 1 1
busl-1.1 name business source licen[sc]e( version)?( 1 1)?
elastic-2.0 tag spdx license identifier elastic 2 0
elastic-2.0 name elastic licen[sc]e (version |v )?2( 0)?
openssl tag spdx license identifier openssl
openssl text this product includes software developed by the openssl project for use in the openssl toolkit
openrail name (creativeml |bigscience )?open rail( m| plus plus)? licen[sc]e
llama name llama (2|3|3 1) community licen[sc]e( agreement)?
"""

#: Creative Commons: what a work must or must not, by the code in identifiers and addresses.
CC_TERMS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Some literal of every signature holds one of these; texts without any have no match.
ROOTS = ("licen", "permission", "gpl", "bsd", "apache", "cc0", "cc  by", "creative", "public  domain", "perl  itself", "redistribut", "advertising", "provided  as  is", "mozilla", "eclipse", "reserved", "confidential", "unauthorized", "mit  no", "unencumbered", "software  developed  by", "mpl", "endorse")


@dataclass(frozen=True)
class Signature:
    """``pattern`` matches in texts whose words are each between two blanks; every match holds ``keyword``."""

    label: str
    priority: int
    score: float
    pattern: str
    keyword: str


def literals(regex: str) -> list[str]:
    """What every match of a signature holds, as far as it stands outside of groups and classes."""
    flat = regex
    while "(" in flat:
        flat = re.sub(r"\([^()]*\)[?*+]?", "\n", flat)
    flat = re.sub(r"\[[^]]*\][?*+]?|.[?*]", "\n", flat)
    return [p.strip(" ").replace(" ", "  ") for p in flat.split("\n") if p.strip(" ")]


def signature(line: str) -> Signature:
    label, kind, regex = line.split(" ", 2)
    priority, score = KINDS[kind]
    return Signature(label, priority, score, f" {regex.replace(' ', '  ')} ".replace("  ?", "(?:  )?"), max(literals(regex), key=len))


def _creative_commons() -> list[str]:
    out = []
    for terms in CC_TERMS:
        for version in CC_VERSIONS:
            label = f"cc-{terms} {version}".replace(" ", "-", terms.count(" ")).replace(" ", "-", 1).replace(" ", ".")
            out += [f"{label} tag spdx license identifier cc {terms} {version}", f"{label} name cc {terms} {version}", f"{label} name (https? )?creativecommons org licenses {terms} {version}"]
    return out


SIGNATURE_LINES = [*(x for x in SIGNATURES.split("\n") if x), *_creative_commons()]
RULES = tuple(signature(x) for x in SIGNATURE_LINES)
#: Phrases whose places count whatever else is found; fixed values.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
