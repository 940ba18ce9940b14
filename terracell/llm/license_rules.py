"""License signatures: hand-written regular expressions over normalised words.

Each entry is (label, keyword, expression). A keyword is a whole word that every
match has (of several, separated by bars, at least one). Expressions see lower-cased
words with single spaces. Entries are in order: within a table, the more specific
comes first. ``license_scan`` gives every table its priority and score.
"""

_L = "licen[cs]e"
_GIVEN = "(?:licen[cs]ed|released|distributed|published|available|provided|offered|covered|redistributed|shared|redistribute it(?: and or modify it)?)"
_UNDER = _GIVEN + " (?:[^ ]+ ){0,4}?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:a |an )?"
_LATER = "(?: (?:only|or later|or any later version|or at your option any later version))?"

# Machine-readable identifiers, as they read in words.
IDENTIFIERS = (
    ("mit-0", "spdx", "spdx license identifier mit 0"),
    ("mit", "spdx", "spdx license identifier mit"),
    ("isc", "spdx", "spdx license identifier isc"),
    ("zlib", "spdx", "spdx license identifier zlib"),
    ("x11", "spdx", "spdx license identifier x11"),
    ("0bsd", "spdx", "spdx license identifier 0bsd"),
    ("bsd-2-clause", "spdx", "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", "spdx", "spdx license identifier bsd 3 clause"),
    ("bsd-4-clause", "spdx", "spdx license identifier bsd 4 clause"),
    ("apache-1.1", "spdx", "spdx license identifier apache 1 1"),
    ("apache-2-llvm", "spdx", "spdx license identifier apache 2 0 with llvm exception"),
    ("apache-2", "spdx", "spdx license identifier apache 2 0"),
    ("gpl-1", "spdx", "spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2-classpath", "spdx", "spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0"),
    ("gpl-2", "spdx", "spdx license identifier gpl 2 0(?: only| or later)?(?: with linux syscall note)?"),
    ("gpl-3", "spdx", "spdx license identifier gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "spdx", "spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "spdx", "spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "spdx", "spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "spdx", "spdx license identifier agpl 3 0(?: only| or later)?"),
    ("mpl-1.1", "spdx", "spdx license identifier mpl 1 1"),
    ("mpl-2", "spdx", "spdx license identifier mpl 2 0(?: no copyleft exception)?"),
    ("epl-1", "spdx", "spdx license identifier epl 1 0"),
    ("epl-2", "spdx", "spdx license identifier epl 2 0"),
    ("cddl-1", "spdx", "spdx license identifier cddl 1 [01]"),
    ("eupl", "spdx", "spdx license identifier eupl 1 [012]"),
    ("bsl-1", "spdx", "spdx license identifier bsl 1 0"),
    ("busl-1.1", "spdx", "spdx license identifier busl 1 1"),
    ("unlicense", "spdx", "spdx license identifier unlicense"),
    ("wtfpl", "spdx", "spdx license identifier wtfpl"),
    ("artistic-2", "spdx", "spdx license identifier artistic 2 0"),
    ("ofl-1.1", "spdx", "spdx license identifier ofl 1 1"),
    ("cc0-1", "spdx", "spdx license identifier cc0 1 0"),
    ("cc-by-nc-nd", "spdx", "spdx license identifier cc by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "spdx", "spdx license identifier cc by nc sa [1234] [05]"),
    ("cc-by-nc", "spdx", "spdx license identifier cc by nc [1234] [05]"),
    ("cc-by-nd", "spdx", "spdx license identifier cc by nd [1234] [05]"),
    ("cc-by-sa", "spdx", "spdx license identifier cc by sa [1234] [05]"),
    ("cc-by", "spdx", "spdx license identifier cc by [1234] [05]"),
    ("postgresql", "spdx", "spdx license identifier postgresql"),
    ("psf-2", "spdx", "spdx license identifier (?:python|psf) 2 0"),
    ("sspl-1", "spdx", "spdx license identifier sspl 1 0"),
    ("elastic-2", "spdx", "spdx license identifier elastic 2 0"),
    ("polyform-nc", "spdx", "spdx license identifier polyform noncommercial 1 0 0"),
)

# Statements by which a work is put under a license.
GRANTS = (
    ("mit", "mit", _UNDER + f"mit(?: x11| expat)?(?: style)? {_L}"),
    ("mit", "expat", _UNDER + f"expat {_L}"),
    ("x11", "x11", _UNDER + f"x11 {_L}"),
    ("isc", "isc", _UNDER + f"isc {_L}"),
    ("zlib", "zlib", _UNDER + f"zlib(?: libpng)? {_L}"),
    ("0bsd", "bsd", _UNDER + f"(?:zero clause bsd|bsd zero clause) {_L}"),
    ("bsd-2-clause", "bsd|freebsd", _UNDER + f"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: style)? {_L}"),
    ("bsd-3-clause", "bsd", _UNDER + f"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: style)? {_L}"),
    ("bsd-4-clause", "bsd", _UNDER + f"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: style)? {_L}"),
    ("bsd", "bsd", _UNDER + f"bsd(?: style)? {_L}"),
    ("apache-2", "apache", _UNDER + f"apache(?: software)? {_L} (?:v |version )?2(?: 0)?"),
    ("apache-1.1", "apache", _UNDER + f"apache(?: software)? {_L} (?:v |version )?1 1"),
    ("apache", "apache", _UNDER + f"apache(?: software)? {_L}"),
    ("agpl-3", "affero", _UNDER + f"gnu affero general public {_L}(?: (?:as published by the free software foundation )?(?:either )?(?:v |version )?3(?: 0)?(?: of the {_L})?)?" + _LATER),
    ("lgpl-2", "library", _UNDER + f"gnu library general public {_L}(?: (?:as published by the free software foundation )?(?:either )?(?:v |version )?2(?: 0)?(?: of the {_L})?)?" + _LATER),
    ("lgpl-2.1", "lesser", _UNDER + f"gnu lesser general public {_L} (?:as published by the free software foundation )?(?:either )?(?:v |version |v2 1|2 1)?(?:2 1)?(?: of the {_L})?" + _LATER),
    ("lgpl-3", "lesser", _UNDER + f"gnu lesser general public {_L} (?:as published by the free software foundation )?(?:either )?(?:v |version )?3(?: 0)?(?: of the {_L})?" + _LATER),
    ("gpl-1", "general", _UNDER + f"gnu general public {_L} (?:as published by the free software foundation )?(?:either )?(?:v |version )?1(?: 0)?(?: of the {_L})?" + _LATER),
    ("gpl-2", "general", _UNDER + f"gnu general public {_L} (?:as published by the free software foundation )?(?:either )?(?:v |version )?2(?: 0)?(?: of the {_L})?" + _LATER),
    ("gpl-3", "general", _UNDER + f"gnu general public {_L} (?:as published by the free software foundation )?(?:either )?(?:v |version )?3(?: 0)?(?: of the {_L})?" + _LATER),
    ("gpl", "general", _UNDER + f"gnu general public {_L}"),
    ("gfdl-1.3", "documentation", _UNDER + f"gnu free documentation {_L}(?: (?:v |version )?1 [123])?" + _LATER),
    ("agpl-3", "agpl|agplv3|agpl3", _UNDER + f"(?:gnu )?agpl(?: ?v?3(?: 0)?)?(?: {_L})?"),
    ("lgpl-2.1", "lgpl|lgplv2|lgpl2", _UNDER + f"(?:gnu )?lgpl ?v?2 1(?: {_L})?"),
    ("lgpl-3", "lgpl|lgplv3|lgpl3", _UNDER + f"(?:gnu )?lgpl ?v?3(?: 0)?(?: {_L})?"),
    ("lgpl", "lgpl", _UNDER + f"(?:gnu )?lgpl(?: {_L})?"),
    ("gpl-2", "gpl|gplv2|gpl2", _UNDER + f"(?:gnu )?gpl(?: ?v| version | )?2(?: 0)?(?: {_L})?" + _LATER),
    ("gpl-3", "gpl|gplv3|gpl3", _UNDER + f"(?:gnu )?gpl(?: ?v| version | )?3(?: 0)?(?: {_L})?" + _LATER),
    ("gpl", "gpl", _UNDER + f"(?:gnu )?gpl(?: {_L})?"),
    ("mpl-1.1", "mozilla", _UNDER + f"mozilla public {_L} (?:v |version )?1 1"),
    ("mpl-2", "mozilla", _UNDER + f"mozilla public {_L} (?:v |version )?2(?: 0)?"),
    ("mpl", "mozilla", _UNDER + f"mozilla public {_L}"),
    ("epl-1", "eclipse", _UNDER + f"eclipse public {_L} (?:v |version )?1(?: 0)?"),
    ("epl-2", "eclipse", _UNDER + f"eclipse public {_L} (?:v |version )?2(?: 0)?"),
    ("edl-1", "eclipse", _UNDER + f"eclipse distribution {_L}(?: (?:v |version )?1(?: 0)?)?"),
    ("cpl-1", "common", _UNDER + f"common public {_L}(?: (?:v |version )?1(?: 0)?)?"),
    ("cddl-1", "distribution", _UNDER + f"common development and distribution {_L}(?: (?:v |version )?1(?: [01])?)?"),
    ("eupl", "european", _UNDER + f"european union public {_L}(?: (?:v |version )?1 [012])?"),
    ("artistic-2", "artistic", _UNDER + f"artistic {_L} (?:v |version )?2(?: 0)?"),
    ("artistic-1", "artistic", _UNDER + f"artistic {_L}"),
    ("perl", "perl", "same terms as (?:the )?perl(?: 5)?(?: programming language)?(?: system)? itself"),
    ("bsl-1", "boost", _UNDER + f"boost software {_L}(?: (?:v |version )?1(?: 0)?)?"),
    ("ofl-1.1", "font", _UNDER + f"(?:sil )?open font {_L}(?: (?:v |version )?1 1)?"),
    ("psf-2", "python", _UNDER + f"python(?: software foundation)? {_L}"),
    ("php-3", "php", _UNDER + f"php {_L}(?: (?:v |version )?3(?: 0[01]?)?)?"),
    ("ms-pl", "microsoft", _UNDER + f"microsoft public {_L}"),
    ("ms-rl", "microsoft", _UNDER + f"microsoft reciprocal {_L}"),
    ("cc0-1", "cc0", _UNDER + f"(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: {_L})?"),
    ("cc-by-nc-nd", "nd", _UNDER + "(?:creative commons )?cc by nc nd(?: [1234](?: [05])?)?"),
    ("cc-by-nc-sa", "sa", _UNDER + "(?:creative commons )?cc by nc sa(?: [1234](?: [05])?)?"),
    ("cc-by-nc", "nc", _UNDER + "(?:creative commons )?cc by nc(?: [1234](?: [05])?)?"),
    ("cc-by-nd", "nd", _UNDER + "(?:creative commons )?cc by nd(?: [1234](?: [05])?)?"),
    ("cc-by-sa", "sa", _UNDER + "(?:creative commons )?cc by sa(?: [1234](?: [05])?)?"),
    ("cc-by", "cc", _UNDER + "(?:creative commons )?cc by(?: [1234](?: [05])?)?"),
    ("cc-by-nc-nd", "commons", _UNDER + "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?"),
    ("cc-by-nc-sa", "commons", _UNDER + "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?"),
    ("cc-by-nc", "commons", _UNDER + "creative commons attribution non ?commercial(?: [1234] [05])?"),
    ("cc-by-nd", "commons", _UNDER + "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?"),
    ("cc-by-sa", "commons", _UNDER + "creative commons attribution share ?alike(?: [1234] [05])?"),
    ("cc-by", "commons", _UNDER + "creative commons attribution(?: [1234] [05])?"),
    ("odbl-1", "database", _UNDER + f"open(?: data commons open)? database {_L}"),
    ("odc-by-1", "attribution", _UNDER + f"open data commons attribution {_L}"),
    ("unlicense", "unlicense", _UNDER + "unlicense"),
    ("wtfpl", "wtfpl", _UNDER + "wtfpl"),
    ("proprietary", "proprietary", _UNDER + f"(?:a )?proprietary {_L}"),
    ("proprietary", "commercial", _UNDER + f"(?:a )?commercial {_L}(?: agreement)?"),
    ("dual", "dual", f"dual {_L}d under"),
)

# Clauses of the licenses' own texts.
CLAUSES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    ("mit", "substantial", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("isc", "isc|purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", "purpose", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("ntp", "purpose", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? (?:with or )?without fee is hereby granted"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "source", "this notice may not be removed or altered from any source distribution"),
    ("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials"),
    ("bsd-3-clause", "endorse", "neither the names? of (?:the )?(?:[^ ]+ ){1,12}?(?:nor the names of (?:its|their|the) (?:contributors|authors) )?may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", "the names? of (?:the )?(?:[^ ]+ ){1,8}?may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd", "merchantability", "this software is provided by (?:the )?(?:[^ ]+ ){1,8}?as is and any express or implied warranties including but not limited to the implied warranties of merchantability"),
    ("apache-2", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http(?:s)? www apache org licenses license 2 0"),
    ("apache-2", "compliance", "you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2", "basis", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", "apache", "apache license version 2 0 january 2004(?: http(?:s)? www apache org licenses)?"),
    ("apache-2", "perpetual", "hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce"),
    ("apache-2", "patent", "perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-2", "notice", "if the work includes a notice text file as part of its distribution"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "convey", "you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-2", "verbatim", "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-2", "whole", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl", "useful", "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl", "useful", "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license"),
    ("agpl-3", "useful", "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license"),
    ("gpl", "along", f"you should have received a copy of the gnu general public {_L} along with"),
    ("lgpl", "along", f"you should have received a copy of the gnu (?:lesser|library) general public {_L} along with"),
    ("agpl-3", "along", f"you should have received a copy of the gnu affero general public {_L} along with"),
    ("lgpl", "library", "work that uses the library(?: in isolation)? is not a derivative work of the library"),
    ("lgpl-3", "combined", "convey a combined work under terms of your choice that taken together effectively do not restrict modification of the portions of the library"),
    ("gfdl-1.3", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at http(?:s)? mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "specific", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language"),
    ("epl-1", "eclipse", "accompanying program is provided under the terms of this eclipse public license"),
    ("epl-1", "eclipse", "made available under the terms of the eclipse public license v1 0 which accompanies this distribution"),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license (?:v |version )?2 0 which (?:is available at|accompanies this distribution)"),
    ("cddl-1", "distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1", "cddl", "use is subject to license terms cddl header (?:start|end)"),
    ("eupl", "eupl", "licen[cs]ed under the eupl"),
    ("bsl-1", "executable", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("bsl-1", "boost", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("cc0-1", "waives", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright"),
    ("cc0-1", "waived", "(?:has|have) waived all copyright and related or neighboring rights"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("artistic-1", "artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2", "establishes", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("ofl-1.1", "font", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("ofl-1.1", "font", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl-1.1", "reserved", "with reserved font names?"),
    ("psf-2", "psf", "psf is making python available to licensee on an as is basis"),
    ("psf-2", "licensee", "grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly"),
    ("php-3", "php", "this product includes php software freely available from"),
    ("ruby", "verbatim", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("ncsa", "deal", "deal with the software without restriction including without limitation the rights to use copy modify merge"),
    ("ms-pl", "contributor", "each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution prepare derivative works of its contribution"),
    ("ms-rl", "reciprocal", "reciprocal grants for any file you distribute that contains code from the software"),
    ("w3c", "obtaining", "this work is being provided by the copyright holders under the following license (?:agreement )?by obtaining"),
    ("w3c", "w3c", "this document is governed by the w3c software"),
    ("sleepycat", "accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("lppl", "latex", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("cecill", "cecill", "governed by the cecill(?: [bc])? license under french law and abiding by the rules of distribution of free software"),
    ("ftl", "freetype", "portions of this software are copyright (?:[^ ]+ ){0,6}?the freetype project"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("curl", "stenberg", "copyright (?:[^ ]+ ){0,6}?daniel stenberg (?:[^ ]+ ){0,8}?all rights reserved permission to use copy modify and distribute"),
    ("upl-1", "larger", "the larger works as defined below to deal in both the software and the larger works"),
    ("elastic-2", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("commons-clause", "sell", "without limiting other conditions in the license the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("cc-by", "share", "you are free to share copy and redistribute the material in any medium or format(?: and)? adapt remix transform and build upon the material for any purpose even commercially"),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "remix", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("odbl-1", "database", "this database is made available under the open database license"),
    ("openrail", "responsible", "responsible ai license"),
    ("llama", "llama", "llama (?:[23] )?community license agreement"),
)

# Names of licenses by themselves.
NAMES = (
    ("mit", "mit", f"mit(?: x11| expat)? {_L}"),
    ("mit", "expat", f"expat {_L}"),
    ("mit", "opensource", "opensource org licenses mit"),
    ("x11", "x11", f"x11 {_L}"),
    ("isc", "isc", f"isc {_L}"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_L}"),
    ("0bsd", "bsd|0bsd", f"(?:0bsd|zero clause bsd {_L}|bsd zero clause {_L})"),
    ("bsd-2-clause", "bsd|freebsd", f"(?:bsd 2 clause(?: {_L})?|2 clause bsd(?: {_L})?|simplified bsd {_L}|freebsd {_L}|two clause bsd {_L})"),
    ("bsd-3-clause", "bsd", f"(?:bsd 3 clause(?: {_L})?|3 clause bsd(?: {_L})?|new bsd {_L}|modified bsd {_L}|revised bsd {_L}|three clause bsd {_L})"),
    ("bsd-4-clause", "bsd", f"(?:bsd 4 clause(?: {_L})?|original bsd {_L}|four clause bsd {_L})"),
    ("bsd", "bsd", f"bsd(?: style)? {_L}"),
    ("apache-2", "apache", f"apache(?: software)? {_L} (?:v|version )?2(?: 0)?"),
    ("apache-2", "apache", "apache org licenses license 2 0"),
    ("apache-2", "apache", "apache 2(?: 0)?"),
    ("apache-1.1", "apache", f"apache(?: software)? {_L} (?:v|version )?1 1"),
    ("apache", "apache", f"apache(?: software)? {_L}"),
    ("gpl-1", "general", f"gnu general public {_L} (?:v|version )?1(?: 0)?"),
    ("gpl-2", "general", f"gnu general public {_L} (?:v|version )?2(?: 0)?"),
    ("gpl-3", "general", f"gnu general public {_L} (?:v|version )?3(?: 0)?"),
    ("gpl", "general", f"gnu general public {_L}"),
    ("gpl-2", "gpl|gplv2|gpl2", "gpl ?v?2(?: 0)?"),
    ("gpl-3", "gpl|gplv3|gpl3", "gpl ?v?3(?: 0)?"),
    ("gpl", "gpl", f"gnu gpl(?: {_L})?"),
    ("lgpl-2.1", "lesser", f"gnu lesser general public {_L} (?:v|version )?2 1"),
    ("lgpl-3", "lesser", f"gnu lesser general public {_L} (?:v|version )?3(?: 0)?"),
    ("lgpl", "lesser", f"gnu lesser general public {_L}"),
    ("lgpl-2", "library", f"gnu library general public {_L}(?: (?:v|version )?2(?: 0)?)?"),
    ("lgpl-2.1", "lgpl|lgplv2|lgpl2", "lgpl ?v?2 1"),
    ("lgpl-3", "lgpl|lgplv3|lgpl3", "lgpl ?v?3(?: 0)?"),
    ("agpl-3", "affero", f"gnu affero general public {_L}(?: (?:v|version )?3(?: 0)?)?"),
    ("agpl-3", "agpl|agplv3|agpl3", "agpl ?v?3(?: 0)?"),
    ("gfdl-1.3", "documentation", f"gnu free documentation {_L}(?: (?:v|version )?1 [123])?"),
    ("mpl-1.1", "mozilla", f"mozilla public {_L} (?:v|version )?1 1"),
    ("mpl-2", "mozilla", f"mozilla public {_L} (?:v|version )?2(?: 0)?"),
    ("mpl", "mozilla", f"mozilla public {_L}"),
    ("mpl-2", "mpl|mplv2|mpl2", "mpl ?v?2(?: 0)?"),
    ("epl-1", "eclipse", f"eclipse public {_L} (?:v|version )?1(?: 0)?"),
    ("epl-2", "eclipse", f"eclipse public {_L} (?:v|version )?2(?: 0)?"),
    ("edl-1", "eclipse", f"eclipse distribution {_L}"),
    ("cpl-1", "common", f"common public {_L}(?: (?:v|version )?1(?: 0)?)?"),
    ("ipl-1", "ibm", f"ibm public {_L}"),
    ("cddl-1", "cddl", "cddl(?: 1 [01])?"),
    ("cddl-1", "distribution", f"common development and distribution {_L}"),
    ("eupl", "european", f"european union public {_L}"),
    ("eupl", "eupl", "eupl(?: 1 [012])?"),
    ("artistic-2", "artistic", f"artistic {_L} 2(?: 0)?"),
    ("artistic-1", "artistic", f"artistic {_L}"),
    ("bsl-1", "boost", f"boost software {_L}"),
    ("busl-1.1", "business", f"business source {_L}(?: 1 1)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl-1.1", "font", f"(?:sil )?open font {_L}"),
    ("psf-2", "python", f"python software foundation {_L}"),
    ("php-3", "php", f"php {_L}"),
    ("ms-pl", "microsoft", f"microsoft public {_L}"),
    ("ms-rl", "microsoft", f"microsoft reciprocal {_L}"),
    ("ecl-2", "educational", f"educational community {_L}"),
    ("afl-3", "academic", f"academic free {_L}"),
    ("osl-3", "software", f"open software {_L}"),
    ("postgresql", "postgresql", f"postgresql {_L}"),
    ("ncsa", "illinois", f"university of illinois(?: ncsa)?(?: open source)? {_L}"),
    ("zpl", "zope", f"zope public {_L}"),
    ("w3c", "w3c", f"w3c software(?: notice and)? {_L}"),
    ("openssl", "openssl", f"openssl {_L}"),
    ("ruby", "ruby", f"ruby {_L}"),
    ("beerware", "beer|beerware", f"(?:beer ware|beerware) {_L}"),
    ("sleepycat", "sleepycat", f"sleepycat {_L}"),
    ("lppl", "latex", f"latex project public {_L}"),
    ("cecill", "cecill", "cecill(?: [bc])?"),
    ("ftl", "freetype", f"freetype {_L}"),
    ("upl-1", "universal", f"universal permissive {_L}"),
    ("qpl-1", "q", f"q public {_L}"),
    ("apsl-2", "apple", f"apple public source {_L}"),
    ("nposl", "profit", f"non profit open software {_L}"),
    ("rpl", "reciprocal", f"reciprocal public {_L}"),
    ("sspl-1", "server", f"server side public {_L}"),
    ("elastic-2", "elastic", f"elastic {_L}(?: 2 0)?"),
    ("polyform-nc", "polyform", f"polyform noncommercial {_L}"),
    ("commons-clause", "clause", f"commons clause {_L}(?: condition)?"),
    ("odbl-1", "database", f"open(?: data commons open)? database {_L}"),
    ("odc-by-1", "attribution", f"open data commons attribution {_L}"),
    ("pddl-1", "dedication", f"public domain dedication and {_L}"),
    ("ogl-3", "government", f"open government {_L}"),
    ("openrail", "openrail", f"(?:big ?science |creative ?ml )?openrail(?: m)?(?: {_L})?"),
    ("cc0-1", "cc0", "cc0(?: 1 0)?"),
    ("cc0-1", "zero", "creative commons zero"),
    ("cc0-1", "publicdomain", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", "nd", "cc by nc nd(?: [1234](?: [05])?)?"),
    ("cc-by-nc-sa", "sa", "cc by nc sa(?: [1234](?: [05])?)?"),
    ("cc-by-nc", "nc", "cc by nc(?: [1234](?: [05])?)?"),
    ("cc-by-nd", "nd", "cc by nd(?: [1234](?: [05])?)?"),
    ("cc-by-sa", "sa", "cc by sa(?: [1234](?: [05])?)?"),
    ("cc-by", "cc", "cc by(?: [1234](?: [05])?)?"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1234] [05]"),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1234] [05]"),
    ("cc-by-nc-nd", "commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike"),
    ("cc-by", "commons", "creative commons attribution"),
)

# Statements that name no license.
STATEMENTS = (
    ("all-rights-reserved", "reserved", "all rights(?: are)? reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "confidential", "confidential and proprietary"),
    ("proprietary", "confidential", "strictly confidential do not (?:copy|distribute)"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "permission", "may not be (?:copied|reproduced|distributed)(?: or (?:copied|reproduced|distributed))? without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
    ("public-domain", "domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "in the public domain"),
    ("public-domain", "domain", "public domain mark(?: 1 0)?"),
    ("no-warranty", "warranty", "without warranty of any kind(?: express or implied)?"),
    ("no-warranty", "warranty", "comes with absolutely no warranty"),
    ("internal", "internal", f"for internal use only(?: not for {_L})?"),
    ("non-commercial", "commercial", f"for non commercial (?:use|purposes) only(?: under {_L})?"),
    ("evaluation", "evaluation", f"evaluation {_L}(?: agreement)?"),
    ("eula", "end", f"end user {_L} agreement"),
)
