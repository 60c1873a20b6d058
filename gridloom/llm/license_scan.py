"""License detection by ordered signature rules.

A text becomes its words, lower case, each with a blank on both sides. There are hundreds of signatures, in a fixed
order: a table of license names, each in the few forms in which licenses are named, and over a hundred clauses, headers
and exceptions as the licenses word them. A signature is tried only where the text has its keyword, and
no text is tried that lacks all gate words. Detections are intervals of words; one that lies inside another of higher
priority (or of the same priority and longer, or alike and from an earlier rule) is suppressed.

All of it is array functions on a row: nothing is shuffled.

Defined results: a null text counts as empty: no words, no labels, score 0, null first and last word. Repeated rows are
scanned each for themselves. The score is the highest confidence of the detections that stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Label, keyword, name as words (a regular expression), identifier as words.
FAMILIES = [
    ("mit", "mit", "mit", "mit"),
    ("mit-0", "mit", "mit (?:no attribution|0)", "mit 0"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version| v)? 1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license)?(?: version| v)? 2(?: 0)?", "apache 2 0"),
    ("gpl-1.0", "general", "gnu general public license(?: version| v)? 1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general", "gnu general public license(?: version| v)? 2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general", "gnu general public license(?: version| v)? 3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "gpl", "gnu gpl", "gpl"),
    ("gpl-2.0", "gplv2", "gplv2", "gplv2"),
    ("gpl-3.0", "gplv3", "gplv3", "gplv3"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license(?: version| v)? 2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", "gnu lesser general public license(?: version| v)? 3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser", "gnu lesser general public", "lgpl"),
    ("lgpl-2.0", "library", "gnu library general public license(?: version| v)? 2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("agpl-3.0", "affero", "gnu affero general public license(?: version| v)? 3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero", "gnu affero general public", "agpl"),
    ("gfdl", "documentation", "gnu free documentation", "gfdl 1 [1-3]"),
    ("bsd-2-clause", "bsd", "(?:2 clause|simplified|freebsd) bsd", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:3 clause|new|modified|revised) bsd", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:4 clause|original|old) bsd", "bsd 4 clause"),
    ("bsd", "bsd", "bsd(?: style)?", "bsd"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? 2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", "mozilla public", "mpl"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? 1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? 2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", "eclipse public", "epl"),
    ("cddl-1.0", "cddl", "cddl(?: version| v)?(?: 1(?: 0)?)?", "cddl 1 0"),
    ("cpl-1.0", "common", "common public license(?: version| v)? 1(?: 0)?", "cpl 1 0"),
    ("eupl-1.2", "european", "european union public", "eupl 1 2"),
    ("isc", "isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", "libpng", "libpng"),
    ("bsl-1.0", "boost", "boost software", "bsl 1 0"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("artistic-1.0", "artistic", "artistic license(?: version| v)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic license(?: version| v)? 2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", "artistic", "artistic"),
    ("python-2.0", "python", "python software foundation", "python 2 0"),
    ("php-3.01", "php", "php(?: version| v)? 3 01", "php 3 01"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa", "ncsa"),
    ("ms-pl", "microsoft", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal", "ms rl"),
    ("osl-3.0", "open", "open software license(?: version| v)? 3(?: 0)?", "osl 3 0"),
    ("afl-3.0", "academic", "academic free license(?: version| v)? 3(?: 0)?", "afl 3 0"),
    ("ofl-1.1", "open", "(?:sil )?open font", "ofl 1 1"),
    ("odbl-1.0", "open", "open (?:data commons open )?database", "odbl 1 0"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?", "cc0 1 0"),
    ("cc-by-3.0", "cc", "cc by 3 0", "cc by 3 0"),
    ("cc-by-4.0", "cc", "cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-3.0", "cc", "cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc", "cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nd-4.0", "cc", "cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-nc-3.0", "cc", "cc by nc 3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "cc", "cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "cc", "cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc", "cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by", "commons", "creative commons attribution", "cc by"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike", "cc by sa"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial", "cc by nc"),
    ("cc", "commons", "creative commons", "cc"),
]
#: Form, priority, confidence. Each form of a name has the gate word "licen" or "spdx".
FORMS = [
    ("spdx license identifier {id}", 5, 1.0),
    ("(?:licensed|license granted) under (?:the |a )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?", 4, 0.95),
    ("(?:released|distributed|published|available|provided) under (?:the |a )?(?:terms of (?:the )?)?{name} licen[cs]e", 4, 0.9),
    ("opensource org licenses {id}", 3, 0.9),
    ("{name} licen[cs]e", 2, 0.8),
]
#: Clauses, headers and exceptions as their licenses word them: label, words, priority, confidence.
CLAUSES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 4, 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 4, 0.95),
    ("mit", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 4, 0.9),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 3, 0.7),
    ("mit", "the software is provided as is without warranty of any kind express or implied", 2, 0.6),
    ("x11", "except as contained in this notice the name of (?:the )?[a-z0-9]+ (?:[a-z0-9]+ )?shall not be used in advertising or otherwise to promote", 4, 0.9),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 4, 0.95),
    ("bsl-1.0", "distributed under the boost software license version 1 0", 5, 0.95),
    ("bsl-1.0", "see accompanying file license 1 0 txt or copy at", 4, 0.8),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 4, 0.9),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", 4, 0.85),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 5, 0.9),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted", 4, 0.85),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 4, 0.9),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 4, 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 4, 0.9),
    ("bsd-3-clause", "neither the name of (?:the )?(?:[a-z0-9]+ ){1,6}nor the names of its contributors may be used to endorse or promote products", 5, 0.9),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", 4, 0.85),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 5, 0.95),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", 5, 0.95),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", 3, 0.8),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license", 5, 0.9),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 5, 1.0),
    ("apache-2.0", "you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0", 5, 1.0),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements", 5, 0.95),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 4, 0.9),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license", 4, 0.85),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 5, 0.95),
    ("apache-2.0", "terms and conditions for use reproduction and distribution 1 definitions license shall mean", 5, 0.95),
    ("apache-2.0", "you must cause any modified files to carry prominent notices stating that you changed the files and you must retain in the source form of any derivative works that you distribute all copyright", 4, 0.85),
    ("apache-1.1", "the names apache and apache software foundation must not be used to endorse or promote products derived from this software without prior written permission", 5, 0.95),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 4, 0.95),
    ("gpl-1.0-or-later", "either version 1 (?:of the license )?or at your option any later version", 5, 0.9),
    ("gpl-2.0-or-later", "either version 2 (?:of the license )?or at your option any later version", 5, 0.9),
    ("gpl-3.0-or-later", "either version 3 (?:of the license )?or at your option any later version", 5, 0.9),
    ("lgpl-2.1-or-later", "either version 2 1 (?:of the license )?or at your option any later version", 5, 0.9),
    ("gpl", "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", 4, 0.9),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", 4, 0.9),
    ("gpl-2.0", "gnu general public license version 2 june 1991", 5, 1.0),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", 5, 1.0),
    ("gpl-1.0", "gnu general public license version 1 february 1989", 5, 1.0),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended", 5, 0.95),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", 5, 0.95),
    ("gpl-2.0", "you may copy and distribute verbatim copies of the program s source code as you receive it", 4, 0.8),
    ("gpl-3.0", "you may convey verbatim copies of the program s source code as you receive it", 4, 0.8),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 3, 0.8),
    ("gpl-2.0-only", "under the terms of (?:the )?gnu general public license version 2 (?:only|as published)", 5, 0.9),
    ("gpl-3.0-only", "under the terms of (?:the )?gnu general public license version 3 (?:only|as published)", 5, 0.9),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 5, 0.95),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this", 4, 0.9),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", 5, 1.0),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", 5, 1.0),
    ("lgpl-2.0", "gnu library general public license version 2 june 1991", 5, 1.0),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 5, 0.95),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", 5, 1.0),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", 5, 0.95),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", 4, 0.9),
    ("agpl-3.0", "remote network interaction use with the gnu general public license", 4, 0.85),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 5, 0.95),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", 3, 0.7),
    ("classpath-exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules", 5, 0.95),
    ("gcc-exception", "gcc runtime library exception", 4, 0.85),
    ("gcc-exception", "as a special exception if you link this library with other files .{0,60}to produce an executable this (?:library|file) does not by itself cause the resulting executable to be covered by the gnu general public license", 5, 0.9),
    ("llvm-exception", "apache license v(?:ersion)? ?2 0 with llvm exceptions", 5, 0.95),
    ("llvm-exception", "as an exception if as a result of your compiling your source code portions of this software are embedded into an object form", 5, 0.9),
    ("autoconf-exception", "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf", 5, 0.95),
    ("bison-exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 5, 0.95),
    ("font-exception", "as a special exception if you create a document which uses this font .{0,80}covered by the gnu general public license", 5, 0.9),
    ("linking-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library", 4, 0.85),
    ("openssl-exception", "permission to link (?:the code of )?this program with (?:any edition of )?the openssl (?:project s openssl )?library", 5, 0.9),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 5, 1.0),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", 5, 0.95),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 5, 1.0),
    ("mpl", "software distributed under the license is distributed on an as is basis without warranty of any kind either express(?:ed)? or implied see the license for the specific language governing rights and limitations", 4, 0.8),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses as defined by the mozilla public license", 5, 0.95),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0", 5, 1.0),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0", 5, 1.0),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license agreement", 5, 0.95),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license agreement", 5, 0.95),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", 5, 0.95),
    ("cddl-1.0", "common development and distribution license cddl", 4, 0.85),
    ("eupl-1.2", "licensed under the eupl version 1 2", 5, 0.95),
    ("eupl-1.1", "licensed under the eupl version 1 1", 5, 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 4, 0.9),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 5, 0.95),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software .{0,40}source distribution", 4, 0.7),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5, 0.95),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software .{0,60}for any purpose commercial or non commercial and by any means .{0,200}public domain", 5, 0.9),
    ("cc0-1.0", "to the extent possible under law (?:the )?(?:[a-z0-9]+ ){1,6}(?:has|have) waived all copyright and related or neighboring rights", 5, 0.95),
    ("cc0-1.0", "creative commons legal code cc0 1 0 universal", 5, 1.0),
    ("cc-by-4.0", "(?:licensed under|available under) (?:a |the )?creative commons attribution 4 0 international license", 5, 0.95),
    ("cc-by-sa-4.0", "(?:licensed under|available under) (?:a |the )?creative commons attribution share ?alike 4 0 international license", 5, 0.95),
    ("cc-by-nc-4.0", "(?:licensed under|available under) (?:a |the )?creative commons attribution non ?commercial 4 0 international license", 5, 0.95),
    ("cc-by-nc-sa-4.0", "(?:licensed under|available under) (?:a |the )?creative commons attribution non ?commercial share ?alike 4 0 international license", 5, 0.95),
    ("cc-by-nd-4.0", "(?:licensed under|available under) (?:a |the )?creative commons attribution no ?deriv(?:ative)?s 4 0 international license", 5, 0.95),
    ("cc-by-sa-3.0", "creative commons attribution share ?alike (?:license )?3 0 unported license", 5, 0.95),
    ("cc-by-3.0", "creative commons attribution 3 0 unported license", 5, 0.95),
    ("cc-by", "creativecommons org licenses by", 4, 0.85),
    ("cc0-1.0", "creativecommons org publicdomain zero", 4, 0.85),
    ("artistic-2.0", "the artistic license 2 0 copyright c 2000 2006 the perl foundation", 5, 1.0),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 5, 0.95),
    ("perl", "this (?:library|program|module) is free software you can redistribute it and or modify it under the same terms as perl itself", 5, 0.9),
    ("wtfpl", "do what the fuck you want to public license", 5, 0.95),
    ("python-2.0", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly", 5, 0.95),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 5, 1.0),
    ("ofl-1.1", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 5, 0.95),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", 5, 0.85),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 5, 0.95),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 5, 0.95),
    ("w3c", "by obtaining and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions", 5, 0.9),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", 4, 0.85),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", 5, 0.9),
    ("beerware", "the beer ware license", 4, 0.9),
    ("json", "the software shall be used for good not evil .{0,120}warranty", 5, 0.8),
    ("busl-1.1", "business source license 1 1", 5, 0.95),
    ("sspl-1.0", "server side public license version 1", 5, 0.95),
    ("elastic-2.0", "elastic license 2 0", 5, 0.95),
    ("elastic-2.0", "licensed under the elastic license", 4, 0.85),
    ("commons-clause", "commons clause license condition", 5, 0.9),
    ("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 3, 0.8),
    ("public-domain", "this (?:work|file|software|code) is (?:hereby )?in the public domain", 3, 0.8),
    ("proprietary", "all rights reserved", 1, 0.5),
    ("proprietary", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|code|document)(?: via any medium)? is strictly prohibited .{0,60}copyright", 4, 0.8),
    ("proprietary", "this software is the confidential and proprietary information of (?:[a-z0-9]+ ){1,6}you shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement", 5, 0.9),
    ("dual", "(?:dual licensed|licensed) under (?:either|both) (?:of )?(?:the )?(?:apache|mit|gpl|bsd)", 3, 0.7),
]
#: The phrases that are always reported.
BASE = [("mit", "license", "mit license"), ("apache", "license", "apache license"), ("gpl", "license", "general public license")]
#: Without any of these, no rule can match: each match of each rule holds one of them within a word, so however the words
#: of a text are set apart, it is found. The tests derive this from the rules.
GATES = ["licen", "spdx", "permi", "redistribut", "public", "copyright", "warrant", "reserved", "option", "exception", "eupl", "linking", "acknowledg", "confidential", "texts", "promot", "verbatim", "misrepresented", "creative", "mpl"]
PRIORITIES = 6


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def _pattern(words: str) -> str:
    return " " + words.replace(" ", "  ").replace("  ?", "(?:  )?") + " "


def keyword(words: str) -> str:
    """The longest word that every match has: of what is neither optional nor one of several."""
    while (less := re.sub(r"\([^()]*\)(?:\?|\{[0-9,]*\})?", " * ", words)) != words:
        words = less
    return max((x for x in words.split() if re.fullmatch("[a-z0-9]+", x)), key=len)


def rules() -> list[Rule]:
    """The base phrases, then each family in each form, then the clauses."""
    found = [(label, keyword, words, 0, 0.6) for label, keyword, words in BASE]
    found += [(label, keyword if "{name}" in form else identifier.split()[0], form.replace("{name}", name).replace("{id}", identifier), priority, confidence) for form, priority, confidence in FORMS for label, keyword, name, identifier in FAMILIES]
    found += [(label, keyword(words), words, priority, confidence) for label, words, priority, confidence in CLAUSES]
    return [Rule(i, label, keyword, _pattern(words), priority, confidence) for i, (label, keyword, words, priority, confidence) in enumerate(found)]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
#: Each word has two blanks of its own, so blanks count words.
_WORDS_IN = "CAST((length({0}) - length(replace({0}, ' ', ''))) / 2 AS INT)"
_SPAN = "struct<n:int,label:string,prio:int,conf:double,s:int,e:int>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_array(some: list[Rule]) -> str:
    return "array(" + ", ".join(f"named_struct('n', {r.number}, 'label', {_quoted(r.label)}, 'kw', {_quoted(' ' + r.keyword)}, 'pat', {_quoted(r.pattern)}, 'prio', {r.priority}, 'conf', {r.confidence}D)" for r in some) + ")"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``base`` and ``spans``: the base phrases' places, and the detections that stay.

    Both are arrays of (rule, label, priority, confidence, first word, word after the last); columns of these names are
    replaced.
    """
    docs = docs.drop("n_words", "base", "spans")
    docs = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    whole = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(whole)
    gate = F.lit(False)
    for word in GATES:
        gate = gate | low.contains(word)
    words = F.expr(f"array_join(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}', 0), '  ')")
    gated = docs.select("row", F.expr(f"CAST(regexp_count(coalesce(text, ''), '{_WORD}') AS BIGINT)").alias("n_words"), F.when(gate, F.concat(F.lit(" "), words, F.lit(" "))).alias("norm"))

    step = f"""(acc, i) -> named_struct(
        'at', acc.at + {_WORDS_IN.format('h.s[i]')} + {_WORDS_IN.format('h.m[i]')},
        'out', concat(acc.out, array(named_struct('n', h.n, 'label', h.label, 'prio', h.prio, 'conf', h.conf,
            's', acc.at + {_WORDS_IN.format('h.s[i]')}, 'e', acc.at + {_WORDS_IN.format('h.s[i]')} + {_WORDS_IN.format('h.m[i]')}))))"""
    found = f"""CASE WHEN norm IS NOT NULL THEN flatten(transform(filter(transform(
        filter({_rule_array(rules())}, r -> contains(norm, r.kw)),
        r -> named_struct('n', r.n, 'label', r.label, 'prio', r.prio, 'conf', r.conf, 'm', regexp_extract_all(norm, r.pat, 0), 's', split(norm, r.pat, -1))),
        h -> size(h.m) > 0),
        h -> aggregate(sequence(0, size(h.m) - 1), named_struct('at', 0, 'out', CAST(array() AS array<{_SPAN}>)), {step}, acc -> acc.out))) END"""
    detected = gated.select("row", "n_words", F.expr(found).alias("found"))
    base = F.expr(f"coalesce(filter(found, x -> x.prio = 0), CAST(array() AS array<{_SPAN}>))")
    # by start, the longer first, the higher priority first: what contains an interval comes before it
    order = "array_sort(found, (x, y) -> CASE WHEN x.s <> y.s THEN x.s - y.s WHEN x.e <> y.e THEN y.e - x.e WHEN x.prio <> y.prio THEN y.prio - x.prio ELSE x.n - y.n END)"
    # the furthest end so far by priority, and what stays
    inside = "exists(sequence(x.prio, size(acc.far) - 1), p -> acc.far[p] >= x.e)"
    kept = f"""CASE WHEN size(found) > 0 THEN aggregate({order},
        named_struct('far', array_repeat(-1, {PRIORITIES}), 'out', CAST(array() AS array<{_SPAN}>)),
        (acc, x) -> named_struct(
            'far', transform(acc.far, (v, p) -> CASE WHEN p = x.prio THEN greatest(v, x.e) ELSE v END),
            'out', CASE WHEN {inside} THEN acc.out ELSE concat(acc.out, array(x)) END),
        acc -> acc.out) ELSE CAST(array() AS array<{_SPAN}>) END"""
    return detected.select("row.*", "n_words", base.alias("base"), F.expr(kept).alias("spans"))


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts and labels of each document."""
    found = scan(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    labels = lambda c: F.transform(c, lambda x: x["label"])
    starts = F.transform("base", lambda x: x["s"])
    return found.select(
        F.col("key").alias(key), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(labels("base")).alias("base_labels"), joined(F.concat(labels("base"), labels("spans"))).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "spans"), lambda x: x["conf"])), F.lit(0.0)).alias("score"),
    )


def oracle_sql() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({r.number}, {text(r.label)}, {text(' ' + r.keyword)}, {text(r.pattern)}, {r.priority}, CAST({r.confidence} AS DOUBLE))" for r in rules())
    words_in = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    return f"""
WITH rules(n, label, kw, pat, prio, conf) AS (VALUES {values}),
d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), norm AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d),
hits AS (
    SELECT doc_id, n, label, prio, conf, regexp_extract_all(t, pat) AS m, string_split_regex(t, pat) AS s
    FROM norm JOIN rules ON contains(t, kw) AND regexp_matches(t, pat)
), numbered AS (SELECT *, unnest(generate_series(1, len(m))) AS i FROM hits),
spans AS (
    SELECT doc_id, n, label, prio, conf,
        list_sum(list_transform(s[1:i], lambda x: {words_in.format('x')})) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: {words_in.format('x')})), 0) AS st,
        {words_in.format('m[i]')} AS len
    FROM numbered
), kept AS (
    SELECT * FROM spans x WHERE prio = 0 OR NOT EXISTS (
        SELECT 1 FROM spans y WHERE y.doc_id = x.doc_id AND y.st <= x.st AND y.st + y.len >= x.st + x.len
        AND (y.prio > x.prio OR y.prio = x.prio AND (y.len > x.len OR y.len = x.len AND y.n < x.n)))
), by_doc AS (
    SELECT doc_id, count(*) FILTER (prio = 0) AS n_base, min(st) FILTER (prio = 0) AS first_word, max(st) FILTER (prio = 0) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (prio = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(conf) AS score
    FROM kept GROUP BY doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM norm LEFT JOIN by_doc USING (doc_id)
"""
