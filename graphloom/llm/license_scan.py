"""License detection by ordered signature rules.

Regexes over the words of a text: license names in the phrasings that cite them, and signatures written one by
one (license bodies, notices, addresses, identifiers). A rule runs only where its keywords occur; overlapping
detections are resolved by priority, and a detection contained in a stronger one is suppressed. The base
phrases are never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Base phrases (in words) and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_V = r"(?:v ?|version ?)?"
_OR = r"(?: or (?:any )?later(?: version)?| only)?"
#: label, priority, keywords of which every one must occur, name (over words joined by single spaces).
LICENSES = (
    ("mit", 60, ("mit|expat",), r"(?:the )?(?:mit|expat)(?: x11)?"),
    ("apache-2", 70, ("apache",), rf"(?:the )?apache(?: software)?(?: license)? ?{_V}2(?: 0)?"),
    ("apache-1.1", 70, ("apache",), rf"(?:the )?apache(?: software)?(?: license)? ?{_V}1 1"),
    ("gpl-3", 70, ("gpl|general public", "3"), rf"(?:the )?(?:gnu )?(?:general public license|gpl) ?{_V}3(?: 0)?{_OR}"),
    ("gpl-2", 70, ("gpl|general public", "2"), rf"(?:the )?(?:gnu )?(?:general public license|gpl) ?{_V}2(?: 0)?{_OR}"),
    ("gpl", 40, ("gnu", "gpl|general public"), r"(?:the )?gnu (?:general public license|gpl)"),
    ("lgpl-3", 75, ("lgpl|lesser general", "3"), rf"(?:the )?(?:gnu )?(?:lesser general public license|lgpl) ?{_V}3(?: 0)?{_OR}"),
    ("lgpl-2.1", 75, ("lgpl|lesser general|library general", "2 1"), rf"(?:the )?(?:gnu )?(?:(?:lesser|library) general public license|lgpl) ?{_V}2 1{_OR}"),
    ("lgpl", 45, ("lgpl|lesser general",), r"(?:the )?(?:gnu )?(?:lesser general public license|lgpl)"),
    ("agpl-3", 75, ("agpl|affero", "3"), rf"(?:the )?(?:gnu )?(?:affero general public license|agpl) ?{_V}3(?: 0)?{_OR}"),
    ("agpl", 45, ("agpl|affero",), r"(?:the )?(?:gnu )?(?:affero general public license|agpl)"),
    ("bsd-2-clause", 70, ("bsd",), r"(?:the )?(?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause)"),
    ("bsd-3-clause", 70, ("bsd",), r"(?:the )?(?:new bsd|revised bsd|modified bsd|(?:3|three) clause bsd|bsd (?:3|three) clause)"),
    ("bsd-4-clause", 70, ("bsd",), r"(?:the )?(?:original bsd|(?:4|four) clause bsd|bsd (?:4|four) clause)"),
    ("bsd", 40, ("bsd",), r"(?:the |a )?bsd(?: style)?"),
    ("isc", 60, ("isc",), r"(?:the )?isc"),
    ("mpl-2", 70, ("mozilla",), rf"(?:the )?mozilla public license ?{_V}2(?: 0)?"),
    ("mpl-1.1", 70, ("mozilla",), rf"(?:the )?mozilla public license ?{_V}1 1"),
    ("mpl", 40, ("mpl",), r"(?:the )?mpl(?: [12] [01])?"),
    ("epl-2", 70, ("eclipse",), rf"(?:the )?eclipse public license ?{_V}2(?: 0)?"),
    ("epl-1", 70, ("eclipse",), rf"(?:the )?eclipse public license ?{_V}1(?: 0)?"),
    ("edl-1", 70, ("eclipse",), rf"(?:the )?eclipse distribution license ?{_V}1(?: 0)?"),
    ("cddl-1", 70, ("common", "distribution"), rf"(?:the )?common development and distribution license(?: {_V}1(?: [01])?)?"),
    ("cpl-1", 70, ("common", "public"), rf"(?:the )?common public license(?: {_V}1(?: 0)?)?"),
    ("artistic-2", 70, ("artistic",), rf"(?:the )?artistic license ?{_V}2(?: 0)?"),
    ("artistic-1", 45, ("artistic",), r"(?:the )?(?:perl )?artistic"),
    ("boost-1", 70, ("boost",), rf"(?:the )?boost software(?: license)?(?: {_V}1(?: 0)?)?"),
    ("zlib", 60, ("zlib",), r"(?:the )?zlib(?: libpng)?"),
    ("unlicense", 60, ("unlicense",), r"(?:the )?unlicense"),
    ("wtfpl", 60, ("wtfpl",), r"(?:the )?wtfpl"),
    ("python-2", 60, ("python",), r"(?:the )?python software foundation"),
    ("php-3", 60, ("php",), rf"(?:the )?php(?: license)? ?{_V}3 0?1?"),
    ("ofl-1.1", 60, ("sil",), rf"(?:the )?sil open font(?: license)?(?: {_V}1 1)?"),
    ("eupl-1.2", 60, ("eupl|european union public",), rf"(?:the )?(?:european union public licen[cs]e|eupl)(?: {_V}1 [12])?"),
    ("ms-pl", 60, ("microsoft",), r"(?:the )?microsoft public"),
    ("ms-rl", 60, ("microsoft",), r"(?:the )?microsoft reciprocal"),
    ("afl-3", 60, ("academic",), rf"(?:the )?academic free license(?: {_V}3(?: 0)?)?"),
    ("osl-3", 60, ("open software",), rf"(?:the )?open software license(?: {_V}3(?: 0)?)?"),
    ("bsl-1.1", 60, ("business source",), rf"(?:the )?business source license(?: {_V}1 1)?"),
    ("sspl-1", 60, ("server side",), rf"(?:the )?server side public license(?: {_V}1)?"),
    ("elastic-2", 60, ("elastic",), rf"(?:the )?elastic license(?: {_V}2(?: 0)?)?"),
    ("gfdl", 60, ("documentation",), rf"(?:the )?(?:gnu )?free documentation license(?: {_V}1 [123])?"),
    ("odbl-1", 60, ("database",), rf"(?:the )?open (?:data commons open )?database license(?: {_V}1(?: 0)?)?"),
    ("cc0-1", 75, ("cc0",), r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", 80, ("cc", "nd"), r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", 80, ("cc", "sa"), r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", 75, ("cc", "nc"), r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", 75, ("cc", "nd"), r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", 75, ("cc", "sa"), r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", 50, ("cc by",), r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", 80, ("creative",), r"(?:a |the )?creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)"),
    ("cc-by-nc-sa", 80, ("creative",), r"(?:a |the )?creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", 75, ("creative",), r"(?:a |the )?creative commons attribution non ?commercial"),
    ("cc-by-nd", 75, ("creative",), r"(?:a |the )?creative commons attribution no ?deriv(?:s|atives)"),
    ("cc-by-sa", 75, ("creative",), r"(?:a |the )?creative commons attribution share ?alike"),
    ("cc-by", 50, ("creative",), r"(?:a |the )?creative commons attribution"),
)
#: phrasing, strength, priority added, keywords, regex around {n}.
PHRASINGS = (
    ("grant", 0.95, 20, ("under",), r"(?:re)?(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistributed)(?: to you)? under(?: the)?(?: terms of)?(?: the)? {n}(?: (?:international|unported|public))*(?: licen[cs]e)?"),
    ("notice", 0.9, 15, ("licen",), r"(?:this|the) [^ ]+(?: [^ ]+){{0,3}} is licen[cs]ed under(?: the)?(?: terms of)?(?: the)? {n}(?: licen[cs]e)?"),
    ("terms", 0.85, 10, ("terms",), r"(?:under|subject to|according to) the terms(?: and conditions)? of (?:the )?{n}(?: licen[cs]e)?"),
    ("tag", 0.95, 18, ("license",), r"(?:spdx license identifier|license) {n}"),
    ("field", 0.8, 8, ("licen",), r"licen[cs]e(?:d)?(?: is| as| by| type)? {n}"),
    ("named", 0.7, 5, ("licen",), r"{n} licen[cs]e"),
)
#: Signatures that stand for themselves: label, kind, strength, priority, keywords, regex.
SIGNATURES = (
    # names that need no phrasing around them
    ("gpl-3", "plain", 0.8, 60, ("general public license version 3",), r"gnu general public license version 3(?: 0)?"),
    ("gpl-2", "plain", 0.8, 60, ("general public license version 2",), r"gnu general public license version 2(?: 0)?"),
    ("cc-by-nc-sa", "plain", 0.6, 80, ("cc by nc sa",), r"cc by nc sa"),
    ("cc-by-nc-nd", "plain", 0.6, 80, ("cc by nc nd",), r"cc by nc nd"),
    ("cc-by-nc", "plain", 0.6, 75, ("cc by nc",), r"cc by nc"),
    ("cc-by-sa", "plain", 0.6, 75, ("cc by sa",), r"cc by sa"),
    ("cc0-1", "plain", 0.6, 75, ("cc0",), r"cc0 1 0 universal"),
    ("public-domain", "plain", 0.5, 30, ("public domain",), r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "plain", 0.4, 20, ("rights reserved",), r"all rights reserved"),
    # sentences of license texts
    ("mit", "body", 0.9, 90, ("hereby granted",), r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "body", 0.7, 85, ("substantial portions",), r"shall be included in all copies or substantial portions of the software"),
    ("isc", "body", 0.9, 90, ("hereby granted",), r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "body", 0.9, 92, ("hereby granted",), r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", "body", 0.8, 85, ("hereby granted",), r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("bsd", "body", 0.9, 85, ("redistribution and use",), r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "body", 0.8, 86, ("endorse or promote",), r"neither the names? of .{1,80}? may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "body", 0.9, 88, ("advertising materials",), r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "body", 0.9, 90, ("apache license",), r"apache license version 2 0 january 2004"),
    ("apache-2", "body", 0.8, 85, ("compliance with the license",), r"you may not use this file except in compliance with the license"),
    ("apache-1.1", "body", 0.8, 85, ("apache software foundation",), r"this product includes software developed by the apache software foundation"),
    ("gpl", "body", 0.8, 50, ("free software",), r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "body", 0.8, 55, ("free software",), r"this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "body", 0.8, 55, ("free software",), r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "body", 0.7, 45, ("received a copy",), r"you should have received a copy of the gnu general public license"),
    ("lgpl", "body", 0.7, 55, ("received a copy",), r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "body", 0.7, 55, ("received a copy",), r"you should have received a copy of the gnu affero general public license"),
    ("gpl-3", "body", 0.9, 90, ("29 june 2007",), r"gnu general public license version 3 29 june 2007"),
    ("gpl-2", "body", 0.9, 90, ("june 1991",), r"gnu general public license version 2 june 1991"),
    ("lgpl-2.1", "body", 0.9, 90, ("february 1999",), r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "body", 0.9, 90, ("29 june 2007",), r"gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "body", 0.9, 90, ("19 november 2007",), r"gnu affero general public license version 3 19 november 2007"),
    ("gfdl", "body", 0.8, 85, ("free documentation license",), r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "body", 0.9, 88, ("source code form",), r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "body", 0.9, 88, ("mozilla public license",), r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2", "body", 0.9, 88, ("eclipse public license",), r"made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl-1", "body", 0.9, 88, ("eclipse public license",), r"made available under the terms of the eclipse public license v1 0"),
    ("cddl-1", "body", 0.9, 88, ("common development",), r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "body", 0.9, 90, ("unencumbered",), r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "body", 0.9, 90, ("you just do what the",), r"you just do what the [^ ]+ you want to"),
    ("zlib", "body", 0.9, 90, ("misrepresented",), r"the origin of this software must not be misrepresented"),
    ("zlib", "body", 0.6, 60, ("express or implied",), r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost-1", "body", 0.9, 90, ("boost software license",), r"boost software license version 1 0 august 17th 2003"),
    ("artistic-2", "body", 0.9, 88, ("everyone is permitted",), r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes"),
    ("gpl", "body", 0.5, 42, ("everyone is permitted",), r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("ofl-1.1", "body", 0.9, 88, ("reserved font name",), r"with reserved font names?"),
    ("cc0-1", "body", 0.9, 88, ("neighboring rights",), r"waived all copyright and related (?:or|and) neighboring rights"),
    ("cc0-1", "body", 0.8, 85, ("extent possible under law",), r"to the extent possible under law .{1,80}? waived all copyright"),
    ("cc-by", "body", 0.7, 60, ("appropriate credit",), r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "body", 0.7, 70, ("same license as the original",), r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "body", 0.7, 70, ("commercial purposes",), r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "body", 0.7, 70, ("modified material",), r"you may not distribute the modified material"),
    ("sspl-1", "body", 0.9, 88, ("offering the program",), r"offering the program as a service"),
    ("bsl-1.1", "body", 0.8, 85, ("change date",), r"effective on the change date"),
    ("elastic-2", "body", 0.8, 85, ("managed service",), r"you may not provide the software to third parties as a hosted or managed service"),
    ("json", "body", 0.9, 90, ("good not evil",), r"the software shall be used for good not evil"),
    ("beerware", "body", 0.9, 90, ("buy me a beer",), r"you can buy me a beer in return"),
    ("python-2", "body", 0.8, 85, ("available to licensee",), r"psf is making python available to licensee"),
    ("openssl", "body", 0.9, 88, ("openssl",), r"this product includes software developed by the openssl project"),
    ("x11", "body", 0.7, 86, ("x consortium",), r"except as contained in this notice the name of the x consortium shall not be used"),
    ("postgresql", "body", 0.9, 88, ("written agreement",), r"without fee and without a written agreement is hereby granted"),
    ("ms-pl", "body", 0.8, 85, ("accompanying software",), r"this license governs use of the accompanying software if you use the software you accept this license"),
    # addresses
    ("mit", "address", 0.9, 80, ("opensource org",), r"opensource org licenses? mit(?: license)?"),
    ("bsd-3-clause", "address", 0.9, 80, ("opensource org",), r"opensource org licenses? bsd 3 clause"),
    ("bsd-2-clause", "address", 0.9, 80, ("opensource org",), r"opensource org licenses? bsd 2 clause"),
    ("isc", "address", 0.9, 80, ("opensource org",), r"opensource org licenses? isc"),
    ("artistic-2", "address", 0.9, 80, ("opensource org",), r"opensource org licenses? artistic(?: license)? 2 0"),
    ("apache-2", "address", 0.9, 82, ("apache org",), r"apache org licenses license 2 0"),
    ("apache-1.1", "address", 0.9, 82, ("apache org",), r"apache org licenses license 1 1"),
    ("gpl-3", "address", 0.9, 82, ("gnu org",), r"gnu org licenses gpl 3 0"),
    ("gpl-2", "address", 0.9, 82, ("gnu org",), r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("lgpl-3", "address", 0.9, 82, ("gnu org",), r"gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", "address", 0.9, 82, ("gnu org",), r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("agpl-3", "address", 0.9, 82, ("gnu org",), r"gnu org licenses agpl 3 0"),
    ("gfdl", "address", 0.9, 82, ("gnu org",), r"gnu org licenses fdl"),
    ("gpl", "address", 0.6, 50, ("gnu org",), r"gnu org licenses gpl"),
    ("lgpl", "address", 0.6, 50, ("gnu org",), r"gnu org licenses lgpl"),
    ("mpl-2", "address", 0.9, 82, ("mozilla org",), r"mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "address", 0.9, 82, ("mozilla org",), r"mozilla org (?:en us )?mpl (?:mpl )?1 1"),
    ("epl-2", "address", 0.9, 82, ("eclipse org",), r"eclipse org legal epl (?:v20|2 0)"),
    ("epl-1", "address", 0.9, 82, ("eclipse org",), r"eclipse org legal epl v10"),
    ("edl-1", "address", 0.9, 82, ("eclipse org",), r"eclipse org org documents edl v10"),
    ("unlicense", "address", 0.9, 82, ("unlicense org",), r"unlicense org"),
    ("wtfpl", "address", 0.8, 80, ("wtfpl net",), r"wtfpl net"),
    ("boost-1", "address", 0.9, 82, ("boost org",), r"boost org license 1 0 txt"),
    ("ofl-1.1", "address", 0.9, 82, ("scripts sil org",), r"scripts sil org ofl"),
    ("odbl-1", "address", 0.9, 82, ("opendatacommons",), r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("elastic-2", "address", 0.9, 82, ("elastic co",), r"elastic co licensing elastic license"),
    ("cc0-1", "address", 0.9, 84, ("creativecommons org",), r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "address", 0.8, 60, ("creativecommons org",), r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc-nd", "address", 0.9, 86, ("creativecommons org",), r"creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "address", 0.9, 86, ("creativecommons org",), r"creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "address", 0.9, 84, ("creativecommons org",), r"creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "address", 0.9, 84, ("creativecommons org",), r"creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "address", 0.9, 84, ("creativecommons org",), r"creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by", "address", 0.9, 82, ("creativecommons org",), r"creativecommons org licenses by(?: [1-4] [05])?"),
    # identifiers behind their tag
    ("gpl-3", "identifier", 0.95, 92, ("spdx license identifier",), r"spdx license identifier gpl 3 0(?: (?:only|or later))?"),
    ("gpl-2", "identifier", 0.95, 92, ("spdx license identifier",), r"spdx license identifier gpl 2 0(?: (?:only|or later))?"),
    ("lgpl-2.1", "identifier", 0.95, 92, ("spdx license identifier",), r"spdx license identifier lgpl 2 1(?: (?:only|or later))?"),
    ("lgpl-3", "identifier", 0.95, 92, ("spdx license identifier",), r"spdx license identifier lgpl 3 0(?: (?:only|or later))?"),
    ("agpl-3", "identifier", 0.95, 92, ("spdx license identifier",), r"spdx license identifier agpl 3 0(?: (?:only|or later))?"),
    ("0bsd", "identifier", 0.95, 92, ("spdx license identifier",), r"spdx license identifier 0bsd"),
    ("bsl-1", "identifier", 0.95, 92, ("spdx license identifier",), r"spdx license identifier bsl 1 0"),
    ("ofl-1.1", "identifier", 0.95, 92, ("spdx license identifier",), r"spdx license identifier ofl 1 1"),
    ("postgresql", "identifier", 0.95, 92, ("spdx license identifier",), r"spdx license identifier postgresql"),
    ("json", "identifier", 0.95, 92, ("spdx license identifier",), r"spdx license identifier json"),
    # notices without a license's name
    ("proprietary", "notice", 0.7, 40, ("confidential",), r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "notice", 0.6, 40, ("prior written",), r"without (?:the )?(?:express )?prior written (?:permission|consent) of"),
    ("proprietary", "notice", 0.6, 40, ("strictly prohibited",), r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [^ ]+){0,12} is strictly prohibited"),
    ("all-rights-reserved", "notice", 0.4, 22, ("rights reserved",), r"copyright (?:c )?(?:19|20)[0-9]{2}(?: [^ ]+){0,8} all rights reserved"),
    ("non-commercial", "notice", 0.5, 35, ("commercial use",), r"(?:for )?non ?commercial use only"),
    ("research-only", "notice", 0.5, 35, ("research|academic",), r"for (?:academic|research)(?: and (?:academic|research|educational))? (?:use|purposes) only"),
    ("personal-use", "notice", 0.4, 30, ("personal",), r"for (?:your )?personal(?: and)?(?: non ?commercial)? use only"),
    ("copyleft", "notice", 0.4, 30, ("copyleft",), r"copyleft all (?:wrongs|rights) reversed"),
    ("public-domain", "notice", 0.5, 32, ("public domain",), r"(?:no copyright|not copyrighted|free of (?:known )?copyright)(?: [^ ]+){0,8} public domain"),
    ("public-domain", "notice", 0.5, 32, ("united states government",), r"(?:a )?work of the united states government"),
    ("ogl-3", "notice", 0.8, 70, ("open government",), r"open government licen[cs]e(?: v ?3(?: 0)?)?"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    strength: float
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, strongest first; ties in the order they are written."""
    whole = lambda x: re.compile(rf"(?<![^ ])(?:{x})(?![^ ])")
    out = [
        Rule(label, kind, strength, priority + more, tuple(dict.fromkeys(keys + also)), whole(around.format(n=f"(?:{name})")))
        for label, priority, keys, name in LICENSES
        for kind, strength, more, also, around in PHRASINGS
    ]
    out += [Rule(label, kind, strength, priority, keys, whole(x)) for label, kind, strength, priority, keys, x in SIGNATURES]
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def _keywords() -> tuple[str, ...]:
    """All keywords; one of the form "a|b" stands for either."""
    return tuple(sorted({k for r in rules() for ks in r.keywords for k in ks.split("|")}))


@lru_cache(maxsize=1)
def _keyed_rules() -> tuple[tuple[Rule, tuple[frozenset[str], ...]], ...]:
    return tuple((r, tuple(frozenset(ks.split("|")) for ks in r.keywords)) for r in rules())


@lru_cache(maxsize=1)
def _gate() -> tuple[tuple[str, ...], ...]:
    """Groups of words: a text that a rule or base phrase can match holds all words of some group.

    Of each rule's keywords the longest one (the least likely to occur by chance) gives its words; they are looked for one by one, so it does
    not matter what stands between them.
    """
    groups = {tuple(phrase.split()) for phrase, _ in BASE}
    for r in rules():
        groups.update(tuple(k.split()) for k in max((ks.split("|") for ks in r.keywords), key=lambda alts: min(map(len, alts))))
    # a group that contains another is found by that one
    wide = lambda g, h: g != h and all(any(x in w for w in g) for x in h)
    groups = [g for g in groups if not any(wide(g, h) and not (wide(h, g) and g < h) for h in groups)]
    # the longest word first: it is missing most often
    return tuple(sorted(tuple(sorted(set(g), key=lambda w: (-len(w), w))) for g in groups))


def _possible(low: str) -> bool:
    return any(all(w in low for w in g) for g in _gate())


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections left after suppression, in text order.

    One that lies inside another of its priority goes, as does one that overlaps an accepted one of higher priority;
    equal priorities may overlap. One sort and one sweep a priority.
    """
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []  # of the stretches that higher priorities cover
    ends: list[int] = []
    for _, same in groupby(sorted(found, key=lambda x: (-x[2].priority, x[0], -x[1], x[2].label)), key=lambda x: x[2].priority):
        far, now = -1, []
        for s, e, r in same:
            i = bisect_right(ends, s)
            if i < len(starts) and starts[i] < e:
                continue
            if e > far:
                now.append((s, e, r))
                far = e
        kept += now
        if now:
            merged: list[list[int]] = []
            for s, e in sorted([*zip(starts, ends, strict=True), *((s, e) for s, e, _ in now)]):
                if merged and s < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            starts, ends = [s for s, _ in merged], [e for _, e in merged]
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].label))


def scan(text: str | None) -> dict:
    """n_words, base places, labels, score and detections (in words) of one text."""
    # bytes have lower case for A-Z alone
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    words = WORD.findall(low)
    out = {"n_words": len(words), "base": [], "found": [], "score": 0.0}
    if not words or not _possible(low):
        return out
    line = " ".join(words)
    spaces = [m.start() for m in re.finditer(" ", line)]
    at = lambda i: bisect_left(spaces, i)
    for phrase, label in BASE:
        i = line.find(phrase)
        while i >= 0:
            if (i == 0 or line[i - 1] == " ") and (i + len(phrase) == len(line) or line[i + len(phrase)] == " "):
                out["base"].append((at(i), label))
            i = line.find(phrase, i + 1)
    have = {k for k in _keywords() if k in line}
    found = [(m.start(), m.end(), r) for r, keys in _keyed_rules() if all(not have.isdisjoint(k) for k in keys) for m in r.pattern.finditer(line)]
    miss = 1.0
    for s, e, r in resolve(found):
        out["found"].append((at(s), at(e) + 1, r.label, r.kind, r.strength))
        miss *= 1 - r.strength
    if out["base"]:
        miss *= 0.05
    out["score"] = round(1 - miss, 9)
    return out


_FOUND = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("strength", pa.float64())]))
_FOUND_SQL = "array<struct<first_word:bigint,end_word:bigint,label:string,rule:string,strength:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).

    Null and empty texts have no words, no labels (empty strings), null positions and a score of 0. Texts are
    scanned whole. Null ids and repeated rows pass through; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(t) for t in b.column(1).to_pylist()]
            base = [[w for w, _ in g["base"]] for g in got]
            named = [{x for _, x in g["base"]} for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g["n_words"] for g in got], pa.int64()),
                    pa.array([len(x) for x in base], pa.int64()),
                    pa.array([min(x, default=None) for x in base], pa.int64()),
                    pa.array([max(x, default=None) for x in base], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in named], pa.string()),
                    pa.array([",".join(sorted(x | {f[2] for f in g["found"]})) for x, g in zip(named, got, strict=True)], pa.string()),
                    pa.array([g["score"] for g in got], pa.float64()),
                    pa.array([[dict(zip(("first_word", "end_word", "label", "rule", "strength"), f, strict=True)) for f in g["found"]] for g in got], _FOUND),
                ],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections {_FOUND_SQL}"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
