"""License signatures: ordered rules over texts of lower-case words parted by single blanks.

Priority 1 are notices and machine tags, 2 named grants, 3 names, 4 general phrases. A rule only runs
where its keyword occurs. The rules of a family follow from its names; the notices are written out.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Signature:
    priority: int
    label: str
    keyword: str
    regex: str


#: label, SPDX words, name as a regex, keyword of the name. Public license names.
FAMILIES = [
    ("mit", "mit", "mit", "mit"),
    ("mit-0", "mit 0", "mit no attribution", "attribution"),
    ("apache-1.1", "apache 1 1", "apache(?: software)?(?: license)?(?: version)? 1 1", "apache"),
    ("apache-2.0", "apache 2 0", "apache(?: license)?(?: version)? 2(?: 0)?", "apache"),
    ("bsd-2-clause", "bsd 2 clause", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)", "bsd"),
    ("bsd-3-clause", "bsd 3 clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)", "bsd"),
    ("bsd-4-clause", "bsd 4 clause", "(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd"),
    ("0bsd", "0bsd", "(?:zero clause bsd|0bsd)", "0bsd"),
    ("isc", "isc", "isc", "isc"),
    ("gpl-1.0", "gpl 1 0", "(?:gnu )?general public license(?: gpl)?(?: version| v)? ?1(?: 0)?", "general"),
    ("gpl-2.0", "gpl 2 0", "(?:gnu )?general public license(?: gpl)?(?: version| v)? ?2(?: 0)?", "general"),
    ("gpl-3.0", "gpl 3 0", "(?:gnu )?general public license(?: gpl)?(?: version| v)? ?3(?: 0)?", "general"),
    ("lgpl-2.0", "lgpl 2 0", "(?:gnu )?library general public license(?: version| v)? ?2(?: 0)?", "library"),
    ("lgpl-2.1", "lgpl 2 1", "(?:gnu )?lesser general public license(?: lgpl)?(?: version| v)? ?2 1", "lesser"),
    ("lgpl-3.0", "lgpl 3 0", "(?:gnu )?lesser general public license(?: lgpl)?(?: version| v)? ?3(?: 0)?", "lesser"),
    ("agpl-3.0", "agpl 3 0", "(?:gnu )?affero general public license(?: agpl)?(?: version| v)? ?3(?: 0)?", "affero"),
    ("gfdl-1.1", "gfdl 1 1", "(?:gnu )?free documentation license(?: version)? 1 1", "documentation"),
    ("gfdl-1.2", "gfdl 1 2", "(?:gnu )?free documentation license(?: version)? 1 2", "documentation"),
    ("gfdl-1.3", "gfdl 1 3", "(?:gnu )?free documentation license(?: version)? 1 3", "documentation"),
    ("mpl-1.1", "mpl 1 1", "mozilla public license(?: version| v)? ?1 1", "mozilla"),
    ("mpl-2.0", "mpl 2 0", "mozilla public license(?: mpl)?(?: version| v)? ?2(?: 0)?", "mozilla"),
    ("epl-1.0", "epl 1 0", "eclipse public license(?: version| v)? ?1(?: 0)?", "eclipse"),
    ("epl-2.0", "epl 2 0", "eclipse public license(?: version| v)? ?2(?: 0)?", "eclipse"),
    ("cddl-1.0", "cddl 1 0", "common development and distribution license(?: version)? ?1 0", "development"),
    ("cddl-1.1", "cddl 1 1", "common development and distribution license(?: version)? ?1 1", "development"),
    ("cpl-1.0", "cpl 1 0", "common public license(?: version)? 1 0", "common"),
    ("eupl-1.1", "eupl 1 1", "european union public licen[cs]e(?: version| v)? ?1 1", "european"),
    ("eupl-1.2", "eupl 1 2", "european union public licen[cs]e(?: version| v)? ?1 2", "european"),
    ("artistic-1.0", "artistic 1 0", "artistic license(?: version)? 1 0", "artistic"),
    ("artistic-2.0", "artistic 2 0", "artistic license(?: version)? 2 0", "artistic"),
    ("bsl-1.0", "bsl 1 0", "boost software license(?: version)? 1 0", "boost"),
    ("busl-1.1", "busl 1 1", "business source license(?: version)? 1 1", "business"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("libpng-2.0", "libpng 2 0", "libpng(?: license)?(?: version)? 2", "libpng"),
    ("ofl-1.1", "ofl 1 1", "(?:sil )?open font license(?: version)? 1 1", "font"),
    ("odbl-1.0", "odbl 1 0", "open database license", "database"),
    ("odc-by-1.0", "odc by 1 0", "open data commons attribution license", "commons"),
    ("pddl-1.0", "pddl 1 0", "public domain dedication and license", "dedication"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "(?:wtfpl|do what the f\\w+ you want to public license)", "license"),
    ("cc0-1.0", "cc0 1 0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?", "license"),
    ("cc-by-4.0", "cc by 4 0", "(?:cc by|creative commons attribution)(?: license)? 4 0(?: international)?", "4"),
    ("cc-by-3.0", "cc by 3 0", "(?:cc by|creative commons attribution)(?: license)? 3 0(?: unported)?", "3"),
    ("cc-by-2.0", "cc by 2 0", "(?:cc by|creative commons attribution)(?: license)? 2 0(?: generic)?", "2"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "(?:cc by sa|creative commons attribution share ?alike)(?: license)? 4 0(?: international)?", "4"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "(?:cc by sa|creative commons attribution share ?alike)(?: license)? 3 0(?: unported)?", "3"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "(?:cc by nc|creative commons attribution non ?commercial)(?: license)? 4 0(?: international)?", "4"),
    ("cc-by-nc-3.0", "cc by nc 3 0", "(?:cc by nc|creative commons attribution non ?commercial)(?: license)? 3 0(?: unported)?", "3"),
    ("cc-by-nc-2.0", "cc by nc 2 0", "(?:cc by nc|creative commons attribution non ?commercial)(?: license)? 2 0(?: generic)?", "2"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "(?:cc by nd|creative commons attribution no ?deriv\\w*)(?: license)? 4 0(?: international)?", "4"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: license)? 4 0(?: international)?", "4"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\\w*)(?: license)? 4 0(?: international)?", "4"),
    ("ms-pl", "ms pl", "microsoft public license", "microsoft"),
    ("ms-rl", "ms rl", "microsoft reciprocal license", "microsoft"),
    ("python-2.0", "python 2 0", "(?:python software foundation|psf) license(?: version 2)?", "license"),
    ("php-3.01", "php 3 01", "php license(?: version)? 3 01", "php"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
    ("openssl", "openssl", "openssl license", "openssl"),
    ("ssleay", "ssleay", "ssleay license", "ssleay"),
    ("x11", "x11", "x11", "x11"),
    ("ncsa", "ncsa", "(?:university of illinois ncsa|ncsa)(?: open source)?", "ncsa"),
    ("vim", "vim", "vim license", "vim"),
    ("w3c", "w3c", "w3c software (?:notice and )?license", "w3c"),
    ("osl-3.0", "osl 3 0", "open software license(?: version)? ?3 0", "software"),
    ("afl-3.0", "afl 3 0", "academic free license(?: version)? ?3 0", "academic"),
    ("ecl-2.0", "ecl 2 0", "educational community license(?: version)? ?2 0", "educational"),
    ("upl-1.0", "upl 1 0", "universal permissive license(?: version| v)? ?1 0", "universal"),
    ("blueoak-1.0.0", "blueoak 1 0 0", "blue oak model license(?: 1 0 0)?", "oak"),
    ("sspl-1.0", "sspl 1 0", "server side public license(?: version| v)? ?1", "server"),
    ("mulanpsl-2.0", "mulanpsl 2 0", "mulan (?:psl|permissive software license)(?: version| v)? ?2", "mulan"),
    ("openrail", "openrail", "(?:creativeml )?open ?rail(?: m)?(?: license)?", "license"),
]

#: Names whose alternatives share no word: keyword and part of the name. Each part is a rule of its own.
PARTS = {
    "bsd-2-clause": [("bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)"), ("freebsd", "freebsd")],
    "0bsd": [("zero", "zero clause bsd"), ("0bsd", "0bsd")],
    "wtfpl": [("wtfpl", "wtfpl"), ("license", "do what the f\\w+ you want to public license")],
    "cc0-1.0": [("cc0", "cc0(?: 1 0)?"), ("zero", "(?:cc zero|creative commons zero)(?: 1 0)?")],
    "openrail": [("openrail", "(?:creativeml )?openrail(?: m)?(?: license)?"), ("rail", "(?:creativeml )?open rail(?: m)?(?: license)?")],
}

#: Wording of notices and grants, written out.
NOTICES = [
    Signature(1, "mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Signature(1, "isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Signature(1, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    Signature(1, "bsd-3-clause", "endorse", "neither the name of (?:\\S+ ){1,12}?may be used to endorse or promote products"),
    Signature(1, "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    Signature(1, "apache-2.0", "apache", "licensed under the apache license version 2 0 the license you may not use this file"),
    Signature(1, "apache-2.0", "apache", "apache license version 2 0 january 2004"),
    Signature(1, "gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Signature(1, "lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    Signature(1, "gpl-3.0", "gnu", "gnu general public license version 3 29 june 2007"),
    Signature(1, "gpl-2.0", "gnu", "gnu general public license version 2 june 1991"),
    Signature(1, "agpl-3.0", "affero", "gnu affero general public license version 3 19 november 2007"),
    Signature(1, "lgpl-2.1", "lesser", "gnu lesser general public license version 2 1 february 1999"),
    Signature(1, "mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v ?2 0"),
    Signature(1, "epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    Signature(1, "bsl-1.0", "boost", "distributed under the boost software license version 1 0"),
    Signature(1, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    Signature(1, "zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    Signature(1, "cc0-1.0", "waived", "(?:has|have) waived all copyright and related (?:or|and) neighbo(?:u)?ring rights"),
    Signature(1, "ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    Signature(1, "gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    Signature(1, "cddl", "development", "the contents of this file are subject to the terms of the common development and distribution license"),
    Signature(1, "public-domain", "domain", "(?:dedicated|released|placed|put) (?:to|into|in) the public domain"),
    Signature(2, "public-domain", "domain", "this (?:work|file|document|text|book|image) is (?:now )?in the public domain"),
    Signature(2, "gpl", "gpl", "(?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?gpl"),
    Signature(2, "lgpl", "lgpl", "(?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?lgpl"),
    Signature(2, "agpl", "agpl", "(?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?agpl"),
    Signature(2, "bsd", "bsd", "(?:licensed|released|distributed|available|published) under (?:the |a )?bsd(?: style)? license"),
    Signature(2, "proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)"),
    Signature(2, "proprietary", "reproduced", "no part of this (?:publication|work|book|document) may be reproduced"),
    Signature(2, "proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use) (?:\\S+ ){0,6}?is (?:strictly )?prohibited"),
    Signature(2, "non-commercial", "commercial", "for (?:personal and )?non commercial use only"),
    Signature(2, "non-commercial", "noncommercial", "for (?:personal and )?noncommercial use only"),
    Signature(2, "non-commercial", "educational", "for educational (?:purposes|use) only"),
    Signature(3, "cc-by", "cc", "cc by"),
    Signature(3, "cc-by-sa", "cc", "cc by sa"),
    Signature(3, "cc-by-nc", "cc", "cc by nc"),
    Signature(3, "cc-by-nd", "cc", "cc by nd"),
    Signature(3, "cc-by-nc-sa", "cc", "cc by nc sa"),
    Signature(3, "cc-by-nc-nd", "cc", "cc by nc nd"),
    Signature(3, "cc-by", "creative", "creative commons attribution"),
    Signature(3, "gpl", "general", "general public license"),
    Signature(3, "lgpl", "lesser", "lesser general public license"),
    Signature(3, "agpl", "affero", "affero general public license"),
    Signature(3, "apache", "apache", "apache license"),
    Signature(3, "bsd", "bsd", "bsd license"),
    Signature(3, "mpl", "mozilla", "mozilla public license"),
    Signature(3, "epl", "eclipse", "eclipse public license"),
    Signature(4, "reserved", "reserved", "all rights reserved"),
    Signature(4, "reserved", "reserved", "(?:some|certain) rights reserved"),
    Signature(4, "copyright", "copyright", "copyright (?:c )?(?:19|20)\\d\\d"),
    Signature(4, "copyright", "copyright", "copyright holders?"),
    Signature(4, "warranty", "warranty", "without warranty of any kind"),
    Signature(4, "spdx", "spdx", "spdx license identifier"),
]


def signatures() -> list[Signature]:
    """All rules in their order: by priority, then as listed."""
    found = list(NOTICES)
    for label, tag, name, keyword in FAMILIES:
        found.append(Signature(1, label, "spdx", f"spdx license identifier {tag}(?: only| or later)?"))
        alone = "licen" in name and "(?: license)" not in name
        for word, part in PARTS.get(label, [(keyword, name)]):
            found.append(Signature(2, label, word, f"(?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?{part}(?: licen[cs]e)?"))
            found.append(Signature(3, label, word, part if alone else f"{part} licen[cs]e"))
    return sorted(found, key=lambda s: s.priority)


#: Phrases whose places are counted, and their labels; fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: A text without any of these has no signature: each rule's regex needs one of them.
GATE = (
    "licen", "copyright", "reserved", "cc by", "cc0", "cc zero", "permission", "warranty", "domain", "redistribution", "advertising materials", "endorse or promote", "proprietary",
    "may be reproduced", "prohibited", "commercial use", "for educational", "creative commons", "released under", "distributed under", "available under", "published under", "provided under", "offered under",
    "wtfpl", "mulan psl",
)
