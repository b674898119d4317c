"""Signature rules of licenses: regexes over words, each behind a keyword, in order of priority.

A rule is written over lower-case words: a blank stands between words, `(..)?` and `|` work on
whole words, and classes with a quantifier may stand inside a word. `pattern` turns a rule into
a regex over numbered words (` apache#7  license#8 `) that both Java and RE2 read. No rule can
overlap itself, none holds an open-ended repetition, and none is longer than `LONGEST` words.
"""

import re
from typing import NamedTuple

LONGEST = 48

TAG, BODY, NOTICE, LINK, TITLE, VAGUE = 1, 1, 2, 2, 3, 4


class Rule(NamedTuple):
    """Smaller priorities win; `base` rules are reported whether or not they are suppressed."""

    keyword: str
    words: str
    label: str
    priority: int
    confidence: float
    base: bool = False


# The phrases and labels that are always reported.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Fixed values: (label, keyword, name in running text, short identifier). The name may be empty.
NAMED = [
    ("apache-2.0", "apache", "apache( software)? licen[sc]e( version| v)? (2|v2)( 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache( software)? licen[sc]e( version| v)? (1|v1) 1", "apache 1 1"),
    ("apache-1.0", "apache", "apache( software)? licen[sc]e( version| v)? (1|v1) 0", "apache 1 0"),
    ("mit", "mit", "mit( x11| expat)?( style)? licen[sc]e", "mit"),
    ("mit-0", "mit", "mit no attribution( licen[sc]e)?", "mit 0"),
    ("x11", "x11", "x11 licen[sc]e", "x11"),
    ("x11", "consortium", "x consortium licen[sc]e", ""),
    ("bsd-1-clause", "bsd", "(1|one) clause bsd( licen[sc]e)?|bsd (1|one) clause( licen[sc]e)?", "bsd 1 clause"),
    ("bsd-2-clause", "bsd", "((2|two) clause|simplified|freebsd) bsd( licen[sc]e)?|bsd (2|two) clause( licen[sc]e)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "((3|three) clause|new|revised|modified) bsd( licen[sc]e)?|bsd (3|three) clause( licen[sc]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "((4|four) clause|original|old) bsd( licen[sc]e)?|bsd (4|four) clause( licen[sc]e)?", "bsd 4 clause"),
    ("0bsd", "bsd", "(zero|0) clause bsd( licen[sc]e)?|bsd zero clause( licen[sc]e)?", "0bsd"),
    ("isc", "isc", "isc licen[sc]e", "isc"),
    ("gpl-1.0", "gpl", "(gplv1|gpl( v| version)? 1( 0)?|gpl v1)", "gpl 1 0( only| or later)?"),
    ("gpl-2.0", "gpl", "(gplv2|gpl v2|gpl( version| v)? 2)( 0)?", "gpl 2 0( only)?"),
    ("gpl-2.0-or-later", "gpl", "(gplv2|gpl v2|gpl( version| v)? 2)( 0)? or( any)? later( version)?", "gpl 2 0 or later"),
    ("gpl-3.0", "gpl", "(gplv3|gpl v3|gpl( version| v)? 3)( 0)?", "gpl 3 0( only)?"),
    ("gpl-3.0-or-later", "gpl", "(gplv3|gpl v3|gpl( version| v)? 3)( 0)? or( any)? later( version)?", "gpl 3 0 or later"),
    ("gpl-1.0", "general", "(gnu )?general public licen[sc]e( version| v)? (1|v1)( 0)?", ""),
    ("gpl-2.0", "general", "(gnu )?general public licen[sc]e( gpl)?( version| v)? (2|v2)( 0)?", ""),
    ("gpl-2.0-or-later", "general", "(gnu )?general public licen[sc]e( gpl)?( either)?( version| v)? (2|v2)( 0)?( of the licen[sc]e)? or( at your option any| any)? later( version)?", ""),
    ("gpl-3.0", "general", "(gnu )?general public licen[sc]e( gpl)?( version| v)? (3|v3)( 0)?", ""),
    ("gpl-3.0-or-later", "general", "(gnu )?general public licen[sc]e( gpl)?( either)?( version| v)? (3|v3)( 0)?( of the licen[sc]e)? or( at your option any| any)? later( version)?", ""),
    ("lgpl-2.0", "library", "(gnu )?library general public licen[sc]e( version| v)? (2|v2)( 0)?", "lgpl 2 0( only| or later)?"),
    ("lgpl-2.1", "lesser", "(gnu )?lesser general public licen[sc]e( version| v)? (2|v2) 1", "lgpl 2 1( only| or later)?"),
    ("lgpl-3.0", "lesser", "(gnu )?lesser general public licen[sc]e( version| v)? (3|v3)( 0)?", "lgpl 3 0( only| or later)?"),
    ("lgpl-2.1", "lgpl", "(lgplv2|lgpl v2|lgpl( version| v)? 2) 1", ""),
    ("lgpl-3.0", "lgpl", "(lgplv3|lgpl v3|lgpl( version| v)? 3)( 0)?", ""),
    ("agpl-3.0", "affero", "(gnu )?affero general public licen[sc]e( version| v)? (3|v3)( 0)?", "agpl 3 0( only| or later)?"),
    ("agpl-1.0", "affero", "affero general public licen[sc]e( version| v)? (1|v1)( 0)?", "agpl 1 0( only| or later)?"),
    ("agpl-3.0", "agpl", "(agplv3|agpl v3|agpl( version| v)? 3)( 0)?", ""),
    ("gfdl-1.1", "documentation", "(gnu )?free documentation licen[sc]e( version| v)? 1 1", "gfdl 1 1( only| or later)?"),
    ("gfdl-1.2", "documentation", "(gnu )?free documentation licen[sc]e( version| v)? 1 2", "gfdl 1 2( only| or later)?"),
    ("gfdl-1.3", "documentation", "(gnu )?free documentation licen[sc]e( version| v)? 1 3", "gfdl 1 3( only| or later)?"),
    ("mpl-1.0", "mozilla", "mozilla public licen[sc]e( version| v)? 1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e( version| v)? 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e( version| v)? (2|v2)( 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e( version| v)? (1|v1)( 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e( version| v)? (2|v2)( 0)?", "epl 2 0"),
    ("edl-1.0", "eclipse", "eclipse distribution licen[sc]e( version| v)? (1|v1)( 0)?", ""),
    ("cpl-1.0", "common", "common public licen[sc]e( version| v)? (1|v1)( 0)?", "cpl 1 0"),
    ("cddl-1.0", "distribution", "common development and distribution licen[sc]e( version| v)? (1|v1) 0", "cddl 1 0"),
    ("cddl-1.1", "distribution", "common development and distribution licen[sc]e( version| v)? (1|v1) 1", "cddl 1 1"),
    ("eupl-1.1", "european", "european union public licen[sc]e( version| v)? 1 1", "eupl 1 1"),
    ("eupl-1.2", "european", "european union public licen[sc]e( version| v)? 1 2", "eupl 1 2"),
    ("cecill-2.1", "cecill", "cecill( free software licen[sc]e)?( agreement)?( version| v)? (2|v2) 1", "cecill 2 1"),
    ("cecill-b", "cecill", "cecill b( licen[sc]e)?", "cecill b"),
    ("cecill-c", "cecill", "cecill c( licen[sc]e)?", "cecill c"),
    ("artistic-1.0", "artistic", "artistic licen[sc]e( version| v)? (1|v1)( 0)?", "artistic 1 0( perl)?"),
    ("artistic-2.0", "artistic", "artistic licen[sc]e( version| v)? (2|v2)( 0)?", "artistic 2 0"),
    ("bsl-1.0", "boost", "boost software licen[sc]e( version| v)? (1|v1)( 0)?", "bsl 1 0"),
    ("busl-1.1", "business", "business source licen[sc]e( version| v)? 1 1", "busl 1 1"),
    ("elastic-2.0", "elastic", "elastic licen[sc]e( version| v)? (2|v2)( 0)?", "elastic 2 0"),
    ("sspl-1.0", "server", "server side public licen[sc]e( version| v)? (1|v1)( 0)?", "sspl 1 0"),
    ("osl-3.0", "open", "open software licen[sc]e( version| v)? (3|v3)( 0)?", "osl 3 0"),
    ("afl-3.0", "academic", "academic free licen[sc]e( version| v)? (3|v3)( 0)?", "afl 3 0"),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", "ms rl"),
    ("odbl-1.0", "database", "open( data commons open)? database licen[sc]e( odbl)?( version| v)?( 1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "attribution", "open data commons attribution licen[sc]e( version| v)?( 1 0)?", "odc by 1 0"),
    ("pddl-1.0", "dedication", "(open data commons )?public domain dedication and licen[sc]e", "pddl 1 0"),
    ("ofl-1.1", "font", "(sil )?open font licen[sc]e( version| v)?( 1 1)?", "ofl 1 1"),
    ("unlicense", "unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[sc]e", "wtfpl"),
    ("zlib", "zlib", "zlib( libpng)? licen[sc]e", "zlib"),
    ("libpng", "libpng", "libpng licen[sc]e", "libpng( 2 0)?"),
    ("psf-2.0", "python", "python( software foundation)? licen[sc]e( version| v)? 2", "psf 2 0"),
    ("python-2.0", "python", "python licen[sc]e 2 0", "python 2 0"),
    ("php-3.01", "php", "php licen[sc]e( version| v)?( 3 01)?", "php 3 01"),
    ("ruby", "ruby", "ruby licen[sc]e", "ruby"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql"),
    ("ncsa", "illinois", "university of illinois( ncsa)? open source licen[sc]e", "ncsa"),
    ("upl-1.0", "universal", "universal permissive licen[sc]e( version| v)?( 1 0)?", "upl 1 0"),
    ("blueoak-1.0.0", "oak", "blue oak model licen[sc]e( 1 0 0)?", "blueoak 1 0 0"),
    ("beerware", "beer", "beer ware licen[sc]e", "beerware"),
    ("hpnd", "historical", "historical permission notice and disclaimer", "hpnd"),
    ("vim", "vim", "vim licen[sc]e", "vim"),
    ("zpl-2.1", "zope", "zope public licen[sc]e( version| v)?( 2 1)?", "zpl 2 1"),
    ("ipl-1.0", "ibm", "ibm public licen[sc]e( version| v)?( 1 0)?", "ipl 1 0"),
    ("nposl-3.0", "profit", "non profit open software licen[sc]e( version| v)?( 3 0)?", "nposl 3 0"),
    ("w3c", "w3c", "w3c software( notice and| and document notice and)? licen[sc]e", "w3c"),
    ("unicode", "unicode", "unicode( data files and software| inc)? licen[sc]e( agreement)?", "unicode (dfs 2016|3 0)"),
    ("openrail-m", "rail", "(creativeml |bigscience )?(openrail|open rail)( m)?( licen[sc]e)?", "openrail"),
    ("llama", "llama", "llama( 2| 3)? community licen[sc]e( agreement)?", "llama2"),
    ("mulan-psl-2.0", "mulan", "mulan permissive software licen[sc]e( version| v)?( 2)?", "mulanpsl 2 0"),
    ("polyform-nc-1.0.0", "polyform", "polyform noncommercial licen[sc]e( 1 0 0)?", "polyform noncommercial 1 0 0"),
]

# Creative Commons clauses, their words in full, and the versions that exist.
CLAUSES = {
    "by": "attribution", "by-sa": "attribution (sharealike|share alike)", "by-nd": "attribution (noderivatives|noderivs|no derivatives|no derivs)",
    "by-nc": "attribution (noncommercial|non commercial)", "by-nc-sa": "attribution (noncommercial|non commercial) (sharealike|share alike)",
    "by-nc-nd": "attribution (noncommercial|non commercial) (noderivatives|noderivs|no derivatives|no derivs)",
}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Fixed values: (label, keyword, confidence, passages of the license itself).
BODIES = [
    ("mit", "hereby", 0.97, ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"]),
    ("mit", "substantial", 0.97, ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"]),
    ("isc", "permission", 0.97, ["permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted"]),
    ("bsd", "redistribution", 0.95, ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"]),
    ("bsd", "redistributions", 0.95, ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
                                      "redistributions in binary form must reproduce the above copyright notice"]),
    ("bsd-3-clause", "endorse", 0.97, ["neither the name of( the)? (copyright holder|[^# ]+|[^# ]+ [^# ]+) nor the names of its contributors may be used to endorse or promote products"]),
    ("bsd-4-clause", "advertising", 0.97, ["all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment"]),
    ("apache-2.0", "apache", 0.97, ["you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at http[s]? www apache org licenses license 2 0"]),
    ("apache-2.0", "compliance", 0.9, ["you may not use this file except in compliance with the licen[sc]e"]),
    ("gpl", "redistribute", 0.95, ["you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"]),
    ("lgpl", "redistribute", 0.95, ["you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public licen[sc]e"]),
    ("agpl-3.0", "redistribute", 0.95, ["you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"]),
    ("gpl", "fitness", 0.8, ["without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (lesser |library |affero )?general public licen[sc]e"]),
    ("gfdl-1.3", "invariant", 0.9, ["with no invariant sections no front cover texts and no back cover texts"]),
    ("mpl-2.0", "mozilla", 0.97, ["this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"]),
    ("mpl-1.1", "mozilla", 0.95, ["the contents of this file are subject to the mozilla public licen[sc]e version 1 1"]),
    ("epl-1.0", "eclipse", 0.95, ["made available under the terms of the eclipse public licen[sc]e (v|version) 1 0"]),
    ("epl-2.0", "eclipse", 0.95, ["made available under the terms of the eclipse public licen[sc]e( v)? 2 0"]),
    ("bsl-1.0", "boost", 0.97, ["distributed under the boost software licen[sc]e version 1 0"]),
    ("zlib", "misrepresented", 0.97, ["the origin of this software must not be misrepresented you must not claim that you wrote the original software"]),
    ("zlib", "warranty", 0.8, ["this software is provided as is without any express or implied warranty"]),
    ("unlicense", "unencumbered", 0.97, ["this is free and unencumbered software released into the public domain"]),
    ("cc0-1.0", "waived", 0.9, ["has waived all copyright and related or neighboring rights"]),
    ("cc0-1.0", "dedicated", 0.85, ["dedicated( this work| the work)? to the public domain"]),
    ("wtfpl", "fuck", 0.97, ["you just do what the fuck you want to"]),
    ("beerware", "beer", 0.97, ["you can buy me a beer in return"]),
    ("ofl-1.1", "font", 0.95, ["this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1"]),
    ("proprietary", "confidential", 0.85, ["(this (document|software|work) is )?proprietary and confidential", "confidential and proprietary"]),
    ("proprietary", "prohibited", 0.8, ["unauthorized (copying|reproduction|distribution|use)( or distribution)?( of this (file|work|document|software))? is( strictly)? prohibited"]),
    ("proprietary", "reproduced", 0.8, ["no part of this (publication|book|work|document) may be reproduced"]),
    ("proprietary", "written", 0.7, ["without( the)?( express| prior)?( prior)? written permission of the (publisher|author|copyright (holder|owner))"]),
    ("public-domain", "domain", 0.8, ["(this (work|file|text) is |released |placed )?in(to)? the public domain", "public domain (work|mark|dedication)"]),
    ("warranty-disclaimer", "merchantability", 0.5, ["warranties of merchantability( and)?( fitness for a particular purpose)?"]),
    ("warranty-disclaimer", "warranty", 0.4, ["provided as is without warranty of any kind"]),
]

# Licenses named without a version or only hinted at.
UNVERSIONED = [
    ("apache", "apache", "apache( software)? licen[sc]e"), ("bsd", "bsd", "bsd( style)? licen[sc]e"),
    ("gpl", "gnu", "gnu (gpl|public licen[sc]e)"), ("lgpl", "lesser", "(gnu )?lesser general public licen[sc]e"),
    ("lgpl", "library", "(gnu )?library general public licen[sc]e"), ("agpl", "affero", "(gnu )?affero general public licen[sc]e"),
    ("gfdl", "documentation", "(gnu )?free documentation licen[sc]e"), ("mpl", "mozilla", "mozilla public licen[sc]e"),
    ("epl", "eclipse", "eclipse public licen[sc]e"), ("cddl", "distribution", "common development and distribution licen[sc]e"),
    ("eupl", "european", "european union public licen[sc]e"), ("cecill", "cecill", "cecill licen[sc]e"),
    ("artistic", "artistic", "artistic licen[sc]e"), ("bsl-1.0", "boost", "boost( software)? licen[sc]e"),
    ("sspl", "server", "server side public licen[sc]e"), ("busl", "business", "business source licen[sc]e"),
    ("cc", "creative", "creative commons( licen[sc]e)?"), ("gpl", "copyleft", "copyleft licen[sc]e"),
    ("osi", "source", "open source licen[sc]e"), ("proprietary", "proprietary", "proprietary licen[sc]e"),
    ("proprietary", "evaluation", "evaluation licen[sc]e( only)?"), ("academic", "academic", "academic use only"),
    ("noncommercial", "commercial", "(for )?non commercial use only"), ("royalty-free", "royalty", "royalty free licen[sc]e"),
    ("copyright", "copyright", "copyright (c )?[0-9][0-9][0-9][0-9]( [0-9][0-9][0-9][0-9])?"),
    ("copyright", "copyright", "copyright (notice|holder[s]?|owner[s]?)"),
    ("licensed", "licen", "see (the )?(accompanying )?licen[sc]e( txt| md)?( file)? for( more)? (details|terms)"),
    ("eula", "end", "end user licen[sc]e agreement"), ("eula", "software", "software licen[sc]e agreement"),
]

_UNDER = "(licen[sc]ed|released|distributed|available|published|provided|shared|redistributed|covered|governed)( as is)? (under|by|with)( the| a| an)?( terms( and conditions)? of( the)?)?"
# Word stems of which at least one stands in any text that a rule can match; looked for first, in one pass each.
GATES = ["licen", "copyright", " public domain", "to the public domain", "cc0", "gpl", " bsd ", "0bsd", " creative commons ", " cc by",
         " all rights reserved ", " hereby granted ", " misrepresented ", " endorse or promote ", " advertising materials ",
         "redistribut", " invariant sections ", " historical permission ", "openrail", " open rail ", " merchantability ", " implied warranty ",
         " without warranty ", "what the fuck ", " buy me a beer ", " proprietary ", " prohibited ", " may be reproduced ",
         " written permission ", " use only ", "spdx", "cecill", " mit no "]


def rules() -> list[Rule]:
    """All rules in order: base phrases, then every license as tag, notice, link and title, then texts and hints."""
    found = [Rule(max(p.split(), key=len) if p != "cc by" else "cc", p, label, VAGUE, {"cc-by": 0.7, "gpl": 0.8, "reserved": 0.6}[label], True)
             for p, label in BASE.items()]
    named = list(NAMED)
    for clause, long in CLAUSES.items():
        short = "cc " + clause.replace("-", " ")
        for v in VERSIONS:
            dotted = v.replace(".", " ")
            name = f"{short} {dotted}|creative commons ({long})( licen[sc]e| international| unported| generic)?( licen[sc]e)?( version)? {dotted}"
            named.append((f"cc-{clause}-{v}", "cc", name.split("|", 1)[0], f"{short} {dotted}"))
            named.append((f"cc-{clause}-{v}", "attribution", name.split("|", 1)[1], ""))
            found.append(Rule("creativecommons", f"creativecommons org licenses {clause.replace('-', ' ')} {dotted}", f"cc-{clause}-{v}", LINK, 0.95))
        if short not in BASE:
            found.append(Rule("cc", short, f"cc-{clause}", VAGUE, 0.75))
        found.append(Rule("creative", f"creative commons ({long})", f"cc-{clause}", VAGUE, 0.75))
    named.append(("cc0-1.0", "cc0", "cc0( 1 0)?( universal)?", "cc0 1 0"))
    named.append(("cc0-1.0", "zero", "creative commons zero( 1 0)?( universal)?", ""))
    for label, keyword, name, short in named:
        if short:
            found.append(Rule("spdx", f"spdx licen[sc]e identifier ({short})", label, TAG, 0.99))
            found.append(Rule("org", f"(opensource|spdx) org licenses ({short})", label, LINK, 0.95))
        if name:
            found.append(Rule(keyword, f"{_UNDER} ({name})", label, NOTICE, 0.95))
            found.append(Rule(keyword, name, label, TITLE, 0.85))
    for label, keyword, confidence, passages in BODIES:
        found += [Rule(keyword, p, label, BODY, confidence) for p in passages]
    for label, keyword, name in UNVERSIONED:
        found.append(Rule(keyword, f"{_UNDER} ({name})", label, NOTICE, 0.7))
        found.append(Rule(keyword, name, label, VAGUE, 0.5))
    return found


_WORD = re.compile(r" +|(?:\[[^\]]*\][+?]?|[a-z0-9])+")


def pattern(words: str) -> str:
    """The rule over numbered words: each word becomes ` word#number `, blanks between words go."""
    return _WORD.sub(lambda m: "" if m[0].isspace() else f" {m[0]}#[0-9]+ ", words)
