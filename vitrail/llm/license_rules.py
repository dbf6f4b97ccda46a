"""Signature rules for licenses, over text as words: lower case, one space before every word.

A rule is (label, keyword, body, weight).  ``body`` is a regular expression over words, found between
word boundaries; the keyword is a word without which the rule can't match.
Rules stand in order of priority: where two detections overlap, the earlier rule's stays.

Each family below is written by hand as names, short names, versions and notices; the rule list is
what they spell out.
"""

from __future__ import annotations

#: Contract phrases and their labels.  FIXED VALUES.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

LICENSE = "licen[sc]e"

#: (label, full name as words, short names, versions as words, suffixes of an identifier)
VERSIONED = (
    ("agpl", "gnu affero general public", ("agpl",), ("1", "3"), ("only", "or later")),
    ("lgpl", "gnu (?:lesser|library) general public", ("lgpl",), ("2", "2 1", "3"), ("only", "or later")),
    ("gpl", "gnu general public", ("gpl", "gnu gpl"), ("1", "2", "3"), ("only", "or later")),
    ("gfdl", "gnu free documentation", ("gfdl", "fdl"), ("1 1", "1 2", "1 3"), ("only", "or later")),
    ("apache", "apache(?: software)?", ("apache", "asl"), ("1", "1 0", "1 1", "2", "2 0"), ()),
    ("mpl", "mozilla public", ("mpl",), ("1 0", "1 1", "2 0"), ("no copyleft exception",)),
    ("epl", "eclipse public", ("epl",), ("1 0", "2 0"), ()),
    ("cddl", "common development and distribution", ("cddl",), ("1 0", "1 1"), ()),
    ("cpl", "common public", ("cpl",), ("0 5", "1 0"), ()),
    ("ipl", "ibm public", ("ipl",), ("1 0",), ()),
    ("eupl", "european union public", ("eupl",), ("1 0", "1 1", "1 2"), ()),
    ("artistic", "artistic", ("artistic",), ("1 0", "2 0"), ("perl", "cl8")),
    ("bsl", "boost software", ("bsl",), ("1 0",), ()),
    ("osl", "open software", ("osl",), ("1 0", "2 0", "2 1", "3 0"), ()),
    ("afl", "academic free", ("afl",), ("1 1", "1 2", "2 0", "2 1", "3 0"), ()),
    ("cecill", "cecill", ("cecill",), ("1 0", "1 1", "2 0", "2 1"), ()),
    ("lppl", "latex project public", ("lppl",), ("1 0", "1 1", "1 2", "1 3a", "1 3c"), ()),
    ("ofl", "sil open font", ("ofl",), ("1 0", "1 1"), ("rfn", "no rfn")),
    ("psf", "python software foundation", ("psf",), ("2", "2 0"), ()),
    ("php", "php", ("php",), ("3 0", "3 01"), ()),
    ("zpl", "zope public", ("zpl",), ("1 1", "2 0", "2 1"), ()),
    ("apsl", "apple public source", ("apsl",), ("1 0", "1 1", "1 2", "2 0"), ()),
    ("npl", "netscape public", ("npl",), ("1 0", "1 1"), ()),
    ("ms-pl", "microsoft public", ("ms pl",), (), ()),
    ("ms-rl", "microsoft reciprocal", ("ms rl",), (), ()),
    ("qpl", "q public", ("qpl",), ("1 0",), ()),
    ("odbl", "open (?:data commons open )?database", ("odbl",), ("1 0",), ()),
    ("odc-by", "open data commons attribution", ("odc by",), ("1 0",), ()),
    ("sspl", "server side public", ("sspl",), ("1", "1 0"), ()),
    ("busl", "business source", ("busl",), ("1 1",), ()),
    ("elastic", "elastic", ("elastic",), ("2 0",), ()),
    ("rpl", "reciprocal public", ("rpl",), ("1 1", "1 5"), ()),
    ("ncsa", "university of illinois ncsa open source", ("ncsa",), (), ()),
    ("unicode", "unicode", ("unicode dfs",), ("2015", "2016", "3"), ()),
    ("w3c", "w3c(?: software)?(?: notice and)?", ("w3c",), (), ()),
    ("openssl", "openssl", ("openssl",), (), ()),
    ("cern-ohl", "cern open hardware", ("cern ohl",), ("1 1", "1 2"), ()),
)

#: Parts of a family's name that its full-name rules need, where the name is no plain word.
KEYWORDS = {"ms-pl": "microsoft", "ms-rl": "microsoft", "qpl": "public", "odc-by": "commons", "apache": "apache", "w3c": "w3c", "odbl": "database"}

CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
CC_KINDS = (
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by", "by", "attribution"),
    ("cc0", "0", "(?:cc0|zero)"),
)

#: Notices that stand for a license without its name: (label, keyword, body, weight).
NOTICES = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.98),
    ("mit", "warranty", "the software is provided as is without warranty of any kind express or implied", 0.8),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.98),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.98),
    ("bsd-3-clause", "endorse", "neither the name of (?:\\S+ ){1,12}may be used to endorse or promote products", 0.95),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display", 0.95),
    ("apache", "apache", "you may not use this file except in compliance with the license(?: \\S+){0,12} apache", 0.95),
    ("apache", "apache", "www apache org licenses license 2 0", 0.98),
    ("gpl", "gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.99),
    ("lgpl", "gnu", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.99),
    ("gpl", "gnu", "www gnu org licenses(?: old licenses)?(?: gpl(?: \\S+){0,3})?", 0.8),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license", 0.99),
    ("mpl", "mozilla", "(?:www )?mozilla org mpl(?: \\S+){0,2}", 0.9),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented", 0.95),
    ("zlib", "zlib", "zlib (?:libpng )?licen[sc]e", 0.9),
    ("bsl", "boost", "distributed under the boost software license", 0.98),
    ("bsl", "boost", "www boost org license 1 0", 0.95),
    ("unlicense", "unlicense", "(?:the )?unlicense", 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 0.99),
    ("public-domain", "domain", "(?:released|placed|dedicated|dedicate|dedicates)(?: \\S+){0,4} (?:in|into|to) the public domain", 0.8),
    ("wtfpl", "wtfpl", "wtfpl(?: version)?(?: 2(?: 0)?)?", 0.95),
    ("wtfpl", "fuck", "do what the fuck you want to(?: public licen[sc]e)?", 0.95),
    ("beerware", "beer", "beer ware(?: licen[sc]e)?|the beer ware license", 0.9),
    ("beerware", "beerware", "beerware(?: licen[sc]e)?", 0.9),
    ("json", "evil", "the software shall be used for good not evil", 0.95),
    ("ofl", "scripts", "scripts sil org ofl", 0.9),
    ("cc", "creativecommons", "(?:www )?creativecommons org licenses", 0.7),
    ("cc0", "creativecommons", "(?:www )?creativecommons org publicdomain zero 1 0", 0.95),
    ("x11", "x11", "(?:mit )?x11 licen[sc]e", 0.9),
    ("mit", "expat", "expat licen[sc]e", 0.9),
    ("mit-0", "mit", "mit (?:0|no attribution)(?: licen[sc]e)?", 0.7),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd) bsd licen[sc]e|bsd 2 clause(?: licen[sc]e)?|2 clause bsd(?: licen[sc]e)?", 0.95),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified) bsd licen[sc]e|bsd 3 clause(?: licen[sc]e)?|3 clause bsd(?: licen[sc]e)?", 0.95),
    ("bsd-4-clause", "bsd", "(?:original|old) bsd licen[sc]e|bsd 4 clause(?: licen[sc]e)?|4 clause bsd(?: licen[sc]e)?", 0.95),
    ("bsd-zero", "0bsd", "0bsd", 0.9),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]es?", 0.85),
    ("isc", "isc", "isc licen[sc]e", 0.95),
    ("curl", "curl", "curl licen[sc]e", 0.9),
    ("ruby", "ruby", "ruby licen[sc]e", 0.8),
    ("perl", "perl", "same terms as perl itself", 0.9),
    ("vim", "vim", "vim licen[sc]e", 0.9),
    ("postgresql", "postgresql", "postgresql licen[sc]e", 0.95),
    ("mulan", "mulan", "mulan (?:permissive|psl)(?: \\S+){0,4}", 0.9),
    ("blueoak", "oak", "blue oak model licen[sc]e(?: 1 0 0)?", 0.95),
    ("llama", "llama", "llama(?: [23](?: [123])?)? community licen[sc]e", 0.95),
    ("openrail", "openrail", "(?:creativeml |bigscience |bigcode )?openrail(?: m)?", 0.9),
    ("openrail", "rail", "(?:creativeml |bigscience |bigcode )?open rail(?: m)?", 0.9),
    ("agpl", "affero", "under the terms of the gnu affero general public license as published by the free software foundation", 0.99),
    ("gpl", "classpath", "gnu general public license(?: version 2)? with (?:the )?classpath exception", 0.95),
    ("gfdl", "document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.99),
    ("apache", "apache", "licensed under the apache license version 2 0 the license", 0.99),
    ("apache", "apache", "this product includes software developed (?:by|at) the apache software foundation", 0.7),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license", 0.99),
    ("ms-pl", "accompanying", "this license governs use of the accompanying software", 0.8),
    ("mpl", "incompatible", "incompatible with secondary licenses as defined by the mozilla public license", 0.95),
    ("cddl", "cddl", "subject to the terms of the common development and distribution license(?: version 1 0)? cddl", 0.95),
    ("ofl", "font", "this font software is licensed under the sil open font license", 0.99),
    ("odbl", "database", "made available under the open database license", 0.95),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights", 0.95),
    ("cc-by-sa", "creative", "this work is licensed under a creative commons attribution share ?alike(?: [1234] [05])? international license", 0.98),
    ("cc-by", "creative", "this work is licensed under a creative commons attribution(?: [1234] [05])? international license", 0.98),
    ("cc-by-sa", "wikipedia", "text from wikipedia is available under the creative commons attribution share ?alike license", 0.9),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 0.9),
    ("x11", "consortium", "the name of the x consortium shall not be used in advertising", 0.95),
    ("hpnd", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose is hereby granted", 0.9),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd-3-clause", "contributors", "names of its contributors may be used to endorse or promote products", 0.9),
    ("busl", "change", "change date(?: \\S+){1,6} change license", 0.85),
    ("eupl", "eupl", "licensed under the eupl", 0.95),
    ("psf", "psf", "psf license agreement for python", 0.95),
    ("artistic", "artistic", "under the (?:terms of the )?artistic license", 0.95),
    ("afl", "academic", "licensed under the academic free license", 0.95),
    ("osl", "osl", "licensed under the open software license osl", 0.95),
    ("public-domain", "domain", "this (?:work|file|document|text) is in the public domain", 0.9),
    ("eula", "eula", "end user license agreement eula|eula end user license agreement", 0.8),
    ("proprietary", "proprietary", "proprietary(?: and confidential)? licen[sc]e|confidential and proprietary", 0.7),
    ("proprietary", "reserved", "copyright(?: \\S+){1,12} all rights reserved", 0.6),
)


def rules() -> list[tuple[str, str, str, float]]:
    """All rules by priority: identifiers, then most specific first, contract phrases last."""
    out: list[tuple[str, str, str, float]] = []
    for label, _, shorts, versions, suffixes in VERSIONED:
        tail = "(?: " + "| ".join(suffixes) + ")?" if suffixes else ""
        for v in reversed(versions):
            if not v.endswith("0") or " " in v:
                out += [(label, "spdx", f"spdx {LICENSE} identifier {s} {v}{tail}", 0.99) for s in shorts]
    for label, short, long in CC_KINDS:
        for v in CC_VERSIONS:
            if label == "cc0" and v != "1 0":
                continue
            ident = "cc0" if label == "cc0" else f"cc {short}"
            key = "cc0" if label == "cc0" else "cc"
            out.append((label, key, f"{ident} {v}(?: (?:international|unported|generic))?", 0.98))
            out.append((label, "creativecommons", f"creativecommons org (?:licenses|publicdomain) {'zero' if label == 'cc0' else short} {v}", 0.98))
            out.append((label, "creative", f"creative commons {long} {v}(?: (?:international|unported|generic))?(?: public)?(?: {LICENSE})?", 0.98))
    for label, name, shorts, versions, suffixes in VERSIONED:
        key = KEYWORDS.get(label, name.split(" ")[-1].split("(")[0])
        for v in reversed(versions):
            out.append((label, key, f"{name} {LICENSE}(?: version| v)? v?{v}(?: or (?:any )?later(?: version)?)?", 0.98))
            out.append((label, key, f"version {v} (?:\\S+ ){{0,6}}{name} {LICENSE}", 0.95))
            for s in shorts:
                tail = "(?: " + "| ".join(suffixes) + ")?" if suffixes else ""
                out.append((label, s.split(" ")[0], f"{s} v?{v}{tail}(?: {LICENSE})?", 0.9))
        for s in shorts:
            out.append((label, s.split(" ")[0], f"{s} licen[sc]ed?", 0.85))
    out += NOTICES
    for label, name, _, _, _ in VERSIONED:
        key = KEYWORDS.get(label, name.split(" ")[-1].split("(")[0])
        out.append((label, key, f"{name} {LICENSE}", 0.9))
    for label, short, long in CC_KINDS:
        key = "cc0" if label == "cc0" else "cc"
        out.append((label, key, "cc0" if label == "cc0" else f"cc {short}", 0.85))
        out.append((label, "creative", f"creative commons {long}", 0.85))
    out.append(("mit", "mit", f"mit {LICENSE}|licensed under(?: the)? mit", 0.9))
    out.append(("other", "licensed", "licensed under the (?:\\S+ ){1,4}licen[sc]e", 0.3))
    return out


def keywords() -> list[str]:
    return sorted({k for _, k, _, _ in rules()} | {p.split(" ")[0] for p, _ in BASE})


#: Words of which a text has one at least if any rule or contract phrase can match.  Keywords that
#: are common words of some language (mit, public, open, ...) stand behind one of these.
GATE = (
    "licen[sc]ed?", "licenses", "gpl", "agpl", "lgpl", "gfdl", "fdl", "asl", "mpl", "epl", "cddl", "cpl", "ipl", "eupl", "bsl", "osl",
    "afl", "cecill", "lppl", "ofl", "psf", "zpl", "apsl", "npl", "qpl", "odbl", "odc", "sspl", "busl", "rpl", "ncsa", "cern", "cc", "cc0",
    "apache", "artistic", "php", "elastic", "unicode", "w3c", "openssl", "ms", "creativecommons", "creative", "spdx", "permission", "warranty",
    "redistribution", "endorse", "advertising", "gnu", "mozilla", "altered", "zlib", "boost", "unlicense", "unencumbered", "domain", "wtfpl",
    "classpath", "waived", "consortium", "redistributions", "contributors", "eula",
    "fuck", "beer", "beerware", "evil", "scripts", "mit (?:0|no)", "bsd", "0bsd", "perl", "mulan", "openrail", "rail", "proprietary", "reserved",
)
