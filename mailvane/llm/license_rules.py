"""Signature rules for license scans.

A family is written by hand: label, names, version signatures, registered ids
and address, and the wording of its grants, conditions and disclaimers. Every
rule is one pattern over the words of a text (lower case, joined by single
blanks) of one of the KINDS; ``rules()`` writes them out. ``operands()`` are
the ids of an SPDX expression behind its first one.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Kind of rule: (priority, confidence). A detection inside one of the same or a higher priority is suppressed.
KINDS = {"tag": (5, 1.0), "notice": (4, 0.95), "address": (3, 0.9), "text": (3, 0.9), "version": (2, 0.85), "name": (1, 0.7), "base": (1, 0.7)}

#: The phrases and labels whose places every scan counts (fixed values).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Names, ids and addresses are those under which the licenses are published (fixed values).
# label: (names, versions, registered ids, address)
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], str]] = {
    "gpl": (("gnu general public license", "gnu gpl", "gnu public license"), ("1", "2", "3"), ("gpl 1 0", "gpl 2 0", "gpl 3 0"), "gnu org licenses gpl"),
    "lgpl": (("gnu lesser general public license", "gnu library general public license", "gnu lgpl"), ("2", "2 1", "3"), ("lgpl 2 0", "lgpl 2 1", "lgpl 3 0"), "gnu org licenses lgpl"),
    "agpl": (("gnu affero general public license", "affero general public license", "gnu agpl"), ("1", "3"), ("agpl 1 0", "agpl 3 0"), "gnu org licenses agpl"),
    "gfdl": (("gnu free documentation license", "gnu fdl"), ("1 1", "1 2", "1 3"), ("gfdl 1 1", "gfdl 1 2", "gfdl 1 3"), "gnu org licenses fdl"),
    "apache": (("apache license", "apache software license", "apache public license"), ("1 0", "1 1", "2 0"), ("apache 1 0", "apache 1 1", "apache 2 0"), "apache org licenses"),
    "mit": (("mit license", "expat license", "mit x11 license"), (), ("mit", "x11"), "opensource org licenses mit"),
    "mit-0": (("mit no attribution license", "mit no attribution"), (), ("mit 0",), "opensource org licenses mit 0"),
    "bsd": (("bsd license", "berkeley software distribution license"), (), ("bsd source code",), "opensource org licenses bsd license"),
    "bsd-2-clause": (("bsd 2 clause license", "simplified bsd license", "freebsd license", "two clause bsd license"), (), ("bsd 2 clause",), "opensource org licenses bsd 2 clause"),
    "bsd-3-clause": (("bsd 3 clause license", "new bsd license", "revised bsd license", "three clause bsd license"), (), ("bsd 3 clause",), "opensource org licenses bsd 3 clause"),
    "bsd-4-clause": (("bsd 4 clause license", "original bsd license", "four clause bsd license"), (), ("bsd 4 clause",), ""),
    "0bsd": (("bsd zero clause license", "zero clause bsd license"), (), ("0bsd",), "opensource org licenses 0bsd"),
    "isc": (("isc license", "internet systems consortium license"), (), ("isc",), "opensource org licenses isc"),
    "mpl": (("mozilla public license",), ("1 0", "1 1", "2 0"), ("mpl 1 0", "mpl 1 1", "mpl 2 0"), "mozilla org mpl"),
    "epl": (("eclipse public license",), ("1 0", "2 0"), ("epl 1 0", "epl 2 0"), "eclipse org legal epl"),
    "edl": (("eclipse distribution license",), ("1 0",), (), "eclipse org org documents edl"),
    "cddl": (("common development and distribution license",), ("1 0", "1 1"), ("cddl 1 0", "cddl 1 1"), "opensource org licenses cddl"),
    "cpl": (("common public license",), ("1 0",), ("cpl 1 0",), "opensource org licenses cpl"),
    "ipl": (("ibm public license",), ("1 0",), ("ipl 1 0",), "opensource org licenses ipl"),
    "eupl": (("european union public licence", "european union public license"), ("1 0", "1 1", "1 2"), ("eupl 1 0", "eupl 1 1", "eupl 1 2"), "joinup ec europa eu eupl"),
    "cecill": (("cecill license", "cecill free software license agreement"), ("1 1", "2 0", "2 1"), ("cecill 1 0", "cecill 2 0", "cecill 2 1"), "cecill info licences"),
    "artistic": (("artistic license", "perl artistic license"), ("1 0", "2 0"), ("artistic 1 0", "artistic 2 0"), "opensource org licenses artistic license"),
    "zlib": (("zlib license", "zlib libpng license"), (), ("zlib", "libpng 2 0"), "opensource org licenses zlib"),
    "boost": (("boost software license",), ("1 0",), ("bsl 1 0",), "boost org license"),
    "unlicense": (("the unlicense",), (), ("unlicense",), "unlicense org"),
    "wtfpl": (("do what the fuck you want to public license",), ("2",), ("wtfpl",), "wtfpl net"),
    "python": (("python software foundation license", "psf license agreement"), ("2",), ("python 2 0", "psf 2 0"), "docs python org license"),
    "php": (("php license",), ("3 0", "3 01"), ("php 3 0", "php 3 01"), "php net license"),
    "ruby": (("ruby license",), (), ("ruby",), "ruby lang org license"),
    "openssl": (("openssl license",), (), ("openssl",), "openssl org source license"),
    "postgresql": (("postgresql license",), (), ("postgresql",), "opensource org licenses postgresql"),
    "ncsa": (("university of illinois ncsa open source license", "ncsa open source license"), (), ("ncsa",), "opensource org licenses ncsa"),
    "ms-pl": (("microsoft public license",), (), ("ms pl",), "opensource org licenses ms pl"),
    "ms-rl": (("microsoft reciprocal license",), (), ("ms rl",), "opensource org licenses ms rl"),
    "osl": (("open software license",), ("1 0", "2 0", "3 0"), ("osl 1 0", "osl 2 0", "osl 3 0"), "opensource org licenses osl"),
    "afl": (("academic free license",), ("2 1", "3 0"), ("afl 2 1", "afl 3 0"), "opensource org licenses afl"),
    "ecl": (("educational community license",), ("1 0", "2 0"), ("ecl 1 0", "ecl 2 0"), "opensource org licenses ecl"),
    "ofl": (("sil open font license", "open font license"), ("1 0", "1 1"), ("ofl 1 0", "ofl 1 1"), "scripts sil org ofl"),
    "odbl": (("open database license", "open data commons open database license"), ("1 0",), ("odbl 1 0",), "opendatacommons org licenses odbl"),
    "odc-by": (("open data commons attribution license",), ("1 0",), ("odc by 1 0",), "opendatacommons org licenses by"),
    "pddl": (("open data commons public domain dedication and license",), ("1 0",), ("pddl 1 0",), "opendatacommons org licenses pddl"),
    "cc-by": (("creative commons attribution license", "creative commons attribution", "cc by"), ("2 0", "2 5", "3 0", "4 0"), ("cc by 2 0", "cc by 3 0", "cc by 4 0"), "creativecommons org licenses by"),
    "cc-by-sa": (("creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"), ("2 0", "3 0", "4 0"), ("cc by sa 3 0", "cc by sa 4 0"), "creativecommons org licenses by sa"),
    "cc-by-nc": (("creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"), ("2 0", "3 0", "4 0"), ("cc by nc 3 0", "cc by nc 4 0"), "creativecommons org licenses by nc"),
    "cc-by-nd": (("creative commons attribution noderivatives", "creative commons attribution noderivs", "cc by nd"), ("2 0", "3 0", "4 0"), ("cc by nd 3 0", "cc by nd 4 0"), "creativecommons org licenses by nd"),
    "cc-by-nc-sa": (("creative commons attribution noncommercial sharealike", "cc by nc sa"), ("2 0", "3 0", "4 0"), ("cc by nc sa 3 0", "cc by nc sa 4 0"), "creativecommons org licenses by nc sa"),
    "cc-by-nc-nd": (("creative commons attribution noncommercial noderivatives", "cc by nc nd"), ("2 0", "3 0", "4 0"), ("cc by nc nd 3 0", "cc by nc nd 4 0"), "creativecommons org licenses by nc nd"),
    "cc0": (("creative commons zero", "cc0 public domain dedication", "cc0"), ("1 0",), ("cc0 1 0",), "creativecommons org publicdomain zero"),
    "public-domain": (("released into the public domain", "dedicated to the public domain"), (), (), "creativecommons org publicdomain mark"),
    "sspl": (("server side public license",), ("1",), ("sspl 1 0",), "mongodb com licensing server side public license"),
    "busl": (("business source license",), ("1 1",), ("busl 1 1",), "mariadb com bsl11"),
    "elastic": (("elastic license",), ("1 0", "2 0"), ("elastic 2 0",), "elastic co licensing elastic license"),
    "openrail": (("open rail m license", "creativeml open rail m"), (), ("openrail",), ""),
    "llama": (("llama community license", "llama 2 community license agreement"), (), (), "llama meta com license"),
    "unicode": (("unicode license agreement", "unicode license"), ("3",), ("unicode 3 0",), "unicode org copyright"),
    "w3c": (("w3c software notice and license", "w3c software and document license"), (), ("w3c",), "w3 org consortium legal"),
    "curl": (("curl license",), (), ("curl",), "curl se docs copyright"),
    "vim": (("vim license",), (), ("vim",), ""),
    "mulan": (("mulan permissive software license", "mulan psl"), ("1", "2"), ("mulanpsl 1 0", "mulanpsl 2 0"), "license coscl org cn mulanpsl"),
    "proprietary": (("all rights reserved",), (), ("licenseref proprietary",), ""),
}


# Wording as published; a text without its title is known by it (fixed values).
_PUBLISHED = "(?:as published by the free software foundation )?"
WORDING: dict[str, tuple[str, ...]] = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software",
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
            "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    "x11": ("shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",
            "redistribution and use in source and binary forms are permitted provided that",
            "redistributions of source code must retain the above copyright notice",
            "redistributions in binary form must reproduce the above copyright notice",
            "this software is provided by the (?:copyright holders?|author|authors|regents)(?: and contributors| or contributors)? as is and any express or implied warranties",
            "in no event shall the (?:copyright (?:holders?|owner)|authors?|regents|foundation)(?: or contributors| and contributors)? be liable for any direct indirect incidental special exemplary or consequential damages"),
    "bsd-3-clause": ("neither the names? of(?: [^ ]+){1,16}? nor the names of (?:its|their|any|other|the)(?: [^ ]+){0,2}? may be used to endorse or promote products derived from this software",
                     "the names? of(?: [^ ]+){1,8}? may not be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-4-clause": ("all advertising materials mentioning features or use of this software must display the following acknowledge?ment",
                     "this product includes software developed by the university of california"),
    "0bsd": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)",),
    "isc": ("permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided",
            "the software is provided as is and (?:the author|isc|internet systems consortium) disclaims all warranties with regard to this software",
            "loss of use data or profits whether in an action of contract negligence or other tortious action"),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable",
             "permission is granted to anyone to use this software for any purpose including commercial applications",
             "the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such",
             "this notice may not be removed or altered from any source distribution"),
    "boost": ("to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
              "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    "unlicense": ("this is free and unencumbered software released into the public domain",
                  "anyone is free to copy modify publish use compile sell or distribute this software",
                  "in jurisdictions that recognize copyright laws the author or authors of this software dedicate"),
    "wtfpl": ("you just do what the fuck you want to",),
    "apache": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
               "you may not use this file except in compliance with the license",
               "see the license for the specific language governing permissions and limitations under the license",
               "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
               "you must cause any modified files to carry prominent notices stating that you changed the files",
               "this product includes software developed by the apache software foundation"),
    "gpl": (f"under the terms of the gnu general public license {_PUBLISHED}(?:either )?version",
            "you should have received a copy of the gnu general public license",
            "see the gnu general public license for more details",
            "the licenses for most software are designed to take away your freedom to share and change it",
            "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium",
            "the gnu general public license is a free copyleft license for software and other kinds of works",
            "the gnu general public license does not permit incorporating your program into proprietary programs"),
    "lgpl": (f"under the terms of the gnu (?:lesser|library) general public license {_PUBLISHED}(?:either )?version",
             "you should have received a copy of the gnu (?:lesser|library) general public license",
             "see the gnu (?:lesser|library) general public license for more details",
             "a program that contains no derivative of any portion of the library but is designed to work with the library",
             "incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    "agpl": (f"under the terms of the gnu affero general public license {_PUBLISHED}(?:either )?version",
             "you should have received a copy of the gnu affero general public license",
             "see the gnu affero general public license for more details",
             "all users interacting with it remotely through a computer network"),
    "gfdl": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
             "with no invariant sections no front cover texts and no back cover texts",
             "to make a manual textbook or other functional and useful document free in the sense of freedom"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license",
            "if a copy of the mpl was not distributed with this file you can obtain one at",
            "this source code form is incompatible with secondary licenses as defined by the mozilla public license",
            "the contents of this file are subject to the mozilla public license version"),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license",
            "the accompanying program is provided under the terms of this eclipse public license"),
    "cpl": ("the accompanying program is provided under the terms of this common public license",),
    "ipl": ("the accompanying program is provided under the terms of this ibm public license",),
    "cddl": ("the contents of this file are subject to the terms of the common development and distribution license",
             "when distributing covered code include this cddl header notice in each file"),
    "eupl": ("licensed under the eupl", "this european union public licence the eupl applies to the work"),
    "cecill": ("this software is governed by the cecill(?: [bc])? license under french law",
               "the fact that you are presently reading this means that you have had knowledge of the cecill"),
    "artistic": ("the intent of this document is to state the conditions under which a package may be copied",
                 "you may make and give away verbatim copies of the source form of the standard version of this package"),
    "python": ("the psf hereby grants licensee a nonexclusive royalty free world wide license",
               "psf is making python available to licensee on an as is basis", "the python software foundation and the individual or organization"),
    "php": ("products derived from this software may not be called php", "this product includes php software freely available from"),
    "openssl": ("this product includes software developed by the openssl project for use in the openssl toolkit",
                "the names openssl toolkit and openssl project must not be used to endorse or promote products"),
    "postgresql": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",),
    "ncsa": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers",
             "to deal with the software without restriction including without limitation the rights to use copy modify merge"),
    "ms-pl": ("this license governs use of the accompanying software if you use the software you accept this license",
              "if you distribute any portion of the software in source code form you may do so only under this license by including a complete copy"),
    "ms-rl": ("reciprocal grants for any file you distribute that contains code from the software",),
    "osl": ("licensed under the open software license version",),
    "afl": ("licensed under the academic free license version",),
    "ecl": ("licensed under the educational community license version",),
    "ofl": ("this font software is licensed under the sil open font license",
            "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces",
            "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    "odbl": ("this database is made available under the open database license",
             "any rights in individual contents of the database are licensed under the database contents license"),
    "odc-by": ("this data is made available under the open data commons attribution license",),
    "pddl": ("this data is made available under the public domain dedication and license",),
    "cc-by": ("this work is licensed under (?:a|the) creative commons attribution(?: [234] [05])?(?: international| unported| generic)? license",),
    "cc-by-sa": ("this work is licensed under (?:a|the) creative commons attribution share ?alike",),
    "cc-by-nc": ("this work is licensed under (?:a|the) creative commons attribution non ?commercial(?! share| no)",),
    "cc-by-nd": ("this work is licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s",),
    "cc-by-nc-sa": ("this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike",),
    "cc-by-nc-nd": ("this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s",),
    "cc0": ("to the extent possible under law(?: [^ ]+){1,12}? (?:has|have) waived all copyright and related or neighboring rights",
            "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    "public-domain": ("this (?:work|file|code|software|program) is (?:hereby )?(?:placed )?in the public domain",
                      "the authors? disclaims? copyright to this source code"),
    "sspl": ("if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available",),
    "busl": ("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work",),
    "elastic": ("you may not provide the software to third parties as a hosted or managed service",
                "you may not move change disable or circumvent the license key functionality in the software"),
    "openrail": ("you agree not to use the model or derivatives of the model", "use based restrictions as referenced in paragraph 5"),
    "llama": ("you will not use the llama materials or any output or results of the llama materials to improve any other large language model",
              "greater than 700 million monthly active users in the preceding calendar month"),
    "unicode": ("to any person obtaining a copy of (?:the unicode )?data files and any associated documentation",),
    "w3c": ("permission to copy modify and distribute this (?:software and its documentation|work) with or without modification for any purpose and without fee or royalty is hereby granted",),
    "curl": ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind",),
    "vim": ("you can distribute a modified vim if you follow one of the following",
            "there are no restrictions on distributing unmodified copies of vim"),
    "mulan": ("you can use this software according to the terms and conditions of the mulan psl",),
    "proprietary": ("this (?:software|document|file) (?:is|contains) (?:the )?confidential and proprietary information",
                    "unauthorized copying of this file via any medium is strictly prohibited"),
}


class Rule(NamedTuple):
    """One signature: ``gate`` are words without which the pattern cannot match, the first the rarest."""
    label: str
    kind: str
    pattern: str
    gate: tuple[str, ...]


def _plain(name: str) -> tuple[str, ...]:
    """Words of a name, the ones of common speech last."""
    common = {"the", "and", "to", "of", "by", "you", "do", "what", "want", "open", "public", "free", "license", "software", "new", "all", "mit"}
    words = dict.fromkeys(name.split())
    return tuple(sorted(words, key=lambda w: (w in common or w.isdigit(), 0)))


def _rare(pattern: str, most: int = 4) -> tuple[str, ...]:
    """The longest words that every match of ``pattern`` holds."""
    flat, was = pattern, ""
    while flat != was:  # what stands in brackets is optional or one of several
        was, flat = flat, re.sub(r"\([^()]*\)(?:\{[^}]*\})?\??", " | ", flat)
    glued = {w for w in flat.split() if not w.isalnum()}
    words = [w for w in dict.fromkeys(flat.split()) if w not in glued]
    edges = {m for m in re.findall(r"(?:^| )([a-z0-9]+)\(", pattern)} | {m for m in re.findall(r"\)\??([a-z0-9]+)", pattern)}
    return tuple(sorted((w for w in words if w not in edges), key=len, reverse=True)[:most])


def rules() -> list[Rule]:
    """All rules, base phrases first."""
    out = [Rule(label, "base", re.escape(p).replace("\\ ", " "), _plain(p)) for p, label in BASE]
    base = {(p, label) for p, label in BASE}
    for label, (names, versions, tags, address) in FAMILIES.items():
        for name in names:
            gate = _plain(name)
            if (name, label) not in base:
                out.append(Rule(label, "name", name, gate))
            out.append(Rule(label, "notice", rf"(?:licen[cs]ed|released|distributed|available|provided|published|covered|governed)"
                                             rf"(?: [^ ]+){{0,2}}? (?:under|by)(?: the)?(?: terms of(?: the)?)? {name}", gate))
            for v in versions:
                out.append(Rule(f"{label}-{v.replace(' ', '.')}", "version", rf"{name}(?: as)?(?: (?:v|version|international))? {v}(?! \d)", gate))
        for tag in tags:
            out.append(Rule("-".join(tag.split()), "tag", rf"spdx license identifier {tag}(?: only| or later)?(?! \d)", ("spdx", "identifier", *_plain(tag))))
        if address:
            out.append(Rule(label, "address", rf"https?(?: www)? {address}", _plain(address)))
    for label, patterns in WORDING.items():
        out.extend(Rule(label, "text", p, _rare(p)) for p in patterns)
    return out


def operands() -> list[Rule]:
    """A rule for each registered id as a later operand of an SPDX expression; the place is that of the id alone.

    Operands are joined by "or", "and" or "with" and hold no word of prose and
    no more than six words behind their first; an expression has up to 600
    characters before its last operand. The patterns look back, which Java's
    expressions can do over a bounded length.
    """
    prose = "the|this|that|you|your|we|may|is|are|use|in|to|of|a|an|under|for|by|see|all|copyright|import|package|include"
    before = rf"(?<![^ ])spdx license identifier (?:(?! (?:{prose}) |(?: (?!(?:or|and|with) )[^ ]+){{7}} ).){{1,600}} (?:or|and|with) "
    return [Rule("-".join(tag.split()), "tag", rf"{tag}(?<={before}{tag})(?: only| or later)?(?! \d)", ("spdx", "identifier", *_plain(tag)))
            for _, _, tags, _ in FAMILIES.values() for tag in tags]
