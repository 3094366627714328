"""License scans by ordered signature rules, in DataFrame functions alone.

A text is normalised to lower-case words between single spaces. Hundreds of expressions, for sentences of licence texts and
notices, grants, tags and names, are gated by a keyword of their own: only those whose keyword occurs are run.
Overlapping detections are resolved by priority: one contained in another of higher priority, or in a longer one
of the same, is dropped.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed phrases and labels of the base count.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: What an expression may abbreviate: words before an identifier, another identifier before it in an SPDX expression, words
#: that grant a licence, words that point to one, and what may follow an identifier or a name.
SHORT = {
    "{tag}": r"(?:spdx license identifier|license|licence) (?:is )?(?:the )?",
    "{also}": r"(?<= spdx license identifier [a-z0-9 ]{1,40} (?:or|and) )",
    "{by}": r"(?:licensed|released|distributed|published|available|redistributed|provided|covered|issued) (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? ",
    "{see}": r"(?:see|read|under|per|conditions of|terms of|copy of) the ",
    "{id}": r"(?: v?\d{1,2}(?: \d{1,2}){0,2})?(?: only| or later)?",
    "{v}": r" ?(?:licen[sc]e )?(?:v|version|ver|release) ?\d+(?: \d+)?(?: of the licen[sc]e)?",
    "{later}": r"(?: or(?: at your option)?(?: any)? (?:later|newer)(?: version)?)?",
    "{L}": r"licen[sc]e",
}
#: Confidence by priority: names, pointers, versions, grants, tags, grants with a version, sentences of licence texts and notices.
SURE = {10: 0.6, 15: 0.7, 20: 0.8, 30: 0.9, 35: 0.9, 40: 0.95, 50: 1.0}
#: The rules in order: label, priority, keyword, and expression over normalised text. Of equal detections the first rule's stays.
RULES = r"""
gpl; 50; free software; (?:this program|this library|this file|it) is free software you can redistribute it and or modify it under the terms of the gnu general public {L}
gpl; 50; general public; you should have received a copy of the gnu general public {L}
gpl; 50; general public; either version \d(?: \d)? of the gnu general public {L}
gpl; 50; general public; everyone is permitted to copy and distribute verbatim copies (?:[a-z0-9]+ ){0,30}?general public {L}
lgpl; 50; lesser general; you should have received a copy of the gnu lesser general public {L}
lgpl; 50; lesser general; it under the terms of the gnu lesser general public {L}
lgpl; 50; library general; it under the terms of the gnu library general public {L}
agpl; 50; affero; it under the terms of the gnu affero general public {L}
agpl; 50; affero; you should have received a copy of the gnu affero general public {L}
gfdl; 50; permission is granted to copy; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L}
apache; 50; licensed under the apache; licensed under the apache {L} version 2 0 the {L} you may not use this file except in compliance
apache; 50; unless required by applicable law; unless required by applicable law or agreed to in writing software distributed under the {L} is distributed on an as is basis
apache; 50; licensed to the apache; licensed to the apache software foundation asf under one or more contributor {L} agreements
apache; 50; this product includes software developed; this product includes software developed (?:at|by) the apache software foundation
mit; 50; permission is hereby granted; permission is hereby granted free of charge to any person obtaining a copy
mit; 50; the above copyright notice; the above copyright notice and this permission notice shall be included in all copies or substantial portions
x11; 50; except as contained in this notice; except as contained in this notice the name of (?:[a-z0-9]+ ){1,9}?shall not be used in advertising
isc; 50; permission to use; permission to use copy modify and or distribute this software for any purpose
0bsd; 50; permission to use; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd; 50; permission to use; permission to use copy modify and distribute this software and its documentation for any purpose
bsd; 50; redistribution and use; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause; 50; neither the name of; neither the name of [a-z0-9 ]{1,60}? may be used to endorse or promote products
bsd-4-clause; 50; all advertising materials; all advertising materials mentioning features or use of this software must display
zlib; 50; this software is provided as is without any express; this software is provided as is without any express or implied warranty in no event
zlib; 50; altered source versions; altered source versions must be plainly marked as such
boost; 50; permission is hereby granted; permission is hereby granted free of charge to any person or organization obtaining a copy
mpl; 50; this source code form; this source code form is subject to the terms of the mozilla public {L}
mpl; 50; mozilla public; the contents of this file are subject to the mozilla public {L}
epl; 50; this program and the accompanying materials; this program and the accompanying materials are made available under the terms of the eclipse public {L}
cddl; 50; common development; the contents of this file are subject to the terms of the common development and distribution {L}
cpl; 50; common public; are made available under the terms of the common public {L}
artistic; 50; the intent of this document; the intent of this document is to state the conditions under which a package may be copied
artistic; 50; same terms as perl; (?:redistribute|redistribution) (?:it )?and or modify it under the same terms as perl itself
unlicense; 50; this is free and unencumbered; this is free and unencumbered software released into the public domain
wtfpl; 50; you just do what; you just do what the fuck you want to
wtfpl; 50; do what the fuck; do what the fuck you want to public {L}
cc0; 50; has waived all copyright; has waived all copyright and related (?:or|and) neighbo(?:u)?ring rights
cc0; 50; to the extent possible under law; to the extent possible under law (?:[a-z0-9]+ ){1,12}?has waived all copyright
ofl; 50; this font software; this font software is licensed under the sil open font {L}
openssl; 50; this product includes software developed; this product includes software developed by the openssl project
python; 50; psf is making; psf is making python available to licensee on an as is basis
php; 50; this product includes php; this product includes php software freely available from
postgresql; 50; in no event shall; in no event shall the university of california be liable to any party for direct indirect special
eupl; 50; licensed under the eupl; licensed under the eupl (?:v|version) ?1 ?\d? ?or as soon they will be approved
ncsa; 50; redistributions of source code; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers
beerware; 50; beer ware; the beer ware {L}
json; 50; the software shall be used for good; the software shall be used for good not evil
public-domain; 50; hereby placed; (?:is|has been) hereby placed in the public domain
public-domain; 50; the author disclaims; the author disclaims copyright to this source code
sqlite; 50; may you do good; may you do good and not evil
proprietary; 50; all rights reserved; all rights reserved
proprietary; 50; proprietary and confidential; proprietary and confidential
proprietary; 50; unauthorized copying; unauthorized copying of this file via any medium is strictly prohibited
proprietary; 50; confidential and proprietary; confidential and proprietary information
gpl; 50; welcome to redistribute; this is free software and you are welcome to redistribute it under certain conditions
gpl; 50; precise terms; the precise terms and conditions for copying distribution and modification follow
gpl; 50; freedom to share; the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change
gpl; 50; referring to freedom; when we speak of free software we are referring to freedom not price our general public licenses
gpl; 50; certain numbered version; if the program specifies that a certain numbered version of the gnu general public {L}
gpl; 50; configuration script; as a special exception to the gnu general public {L} if you distribute this file as part of a program that contains a configuration script
gpl-exception; 50; special exception; as a special exception the copyright holders of this (?:library|program|file) give (?:you )?permission to link
lgpl; 50; derivative work; such a work in isolation is not a derivative work of the library and therefore falls outside the scope of this {L}
agpl; 50; interacting with it remotely; must prominently offer all users interacting with it remotely through a computer network
agpl; 50; network server software; specifically designed to ensure cooperation with the community in the case of network server software
gfdl; 50; invariant sections; with (?:no|the) invariant sections (?:[a-z0-9]+ ){0,20}?no back cover texts
gfdl; 50; section entitled; a copy of the {L} is included in the section entitled gnu free documentation {L}
apache; 50; apache org licenses; you may obtain a copy of the {L} at https? www apache org licenses license 2 0
apache; 50; governing permissions; see the {L} for the specific language governing permissions and limitations under the {L}
apache; 50; each contributor hereby grants; subject to the terms and conditions of this {L} each contributor hereby grants to you a perpetual worldwide
mit; 50; without restriction; to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit; 50; noninfringement; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit; 50; authors or copyright holders; in no event shall the authors or copyright holders be liable for any claim damages or other liability
x11; 50; dealings in this software; shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
isc; 50; the author disclaims all; the software is provided as is and the author disclaims all warranties with regard to this software
bsd; 50; copyright holders and contributors; this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd; 50; redistributions in binary form; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd; 50; redistributions of source code; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause; 50; views and conclusions; the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
bsd-3-clause; 50; name of the author; the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause; 50; university of california berkeley; this product includes software developed by the university of california berkeley and its contributors
zlib; 50; must not be misrepresented; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; 50; granted to anyone; permission is granted to anyone to use this software for any purpose including commercial applications
libpng; 50; this source code; permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose
libtiff; 50; distribute and sell; permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
curl; 50; with or without fee; permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
ntp; 50; with or without fee; permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
unicode; 50; unicode data files; permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
boost; 50; accompanying documentation; the software and accompanying documentation covered by this {L} the software to use reproduce display distribute execute and transmit
mpl; 50; copy of the mpl; if a copy of the mpl was not distributed with this file you can obtain one at
mpl; 50; governing rights; see the {L} for the specific language governing rights and limitations under the {L}
mpl; 50; incompatible with secondary; this source code form is incompatible with secondary licenses
epl; 50; eclipse public; this program and the accompanying materials are made available under the terms of the eclipse public {L} (?:v ?)?[12] 0
epl; 50; secondary licenses; this source code may also be made available under the following secondary licenses
epl; 50; accompanying program; the accompanying program is provided under the terms of this eclipse public {L}
cpl; 50; accompanying program; the accompanying program is provided under the terms of this common public {L}
ibm-pl; 50; accompanying program; the accompanying program is provided under the terms of this ibm public {L}
cddl; 50; opensolaris; you can obtain a copy of the {L} at usr src opensolaris {L} or
cddl; 50; cddl header; when distributing covered (?:code|software) include this cddl header (?:notice )?in each file
artistic; 50; standard version; you may make and give away verbatim copies of the source form of the standard version of this package
artistic; 50; given free software package; this {L} establishes the terms under which a given free software package may be copied
ruby; 50; the source form of the software; you may make and give away verbatim copies of the source form of the software without restriction
ruby; 50; 2 clause bsdl; you can redistribute it and or modify it under either the terms of the 2 clause bsdl
unlicense; 50; anyone is free to copy; anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
unlicense; 50; any and all copyright interest; dedicate any and all copyright interest in the software to the public domain
wtfpl; 50; changing it is allowed; copies of this {L} document and changing it is allowed as long as the name is changed
cc0; 50; associated a work; the person who associated a work with this deed has dedicated the work to the public domain
cc0; 50; creativecommons org publicdomain; creativecommons org publicdomain zero 1 0
public-domain; 50; creativecommons org publicdomain; creativecommons org publicdomain mark 1 0
cc-by; 50; creativecommons org licenses; creativecommons org licenses by \d \d
cc-by-sa; 50; creativecommons org licenses; creativecommons org licenses by sa \d \d
cc-by-nc; 50; creativecommons org licenses; creativecommons org licenses by nc \d \d
cc-by-nd; 50; creativecommons org licenses; creativecommons org licenses by nd \d \d
cc-by-nc-sa; 50; creativecommons org licenses; creativecommons org licenses by nc sa \d \d
cc-by-nc-nd; 50; creativecommons org licenses; creativecommons org licenses by nc nd \d \d
ofl; 50; reserved font name; with reserved font names? [a-z0-9]+
ofl; 50; is also available with a faq; this {L} is copied below and is also available with a faq at
openssl; 50; any form whatsoever; redistributions of any form whatsoever must retain the following acknowledg(?:e)?ment this product includes software developed by the openssl project
openssl; 50; openssl toolkit; the names openssl toolkit and openssl project must not be used to endorse or promote products
ssleay; 50; eric young; this product includes cryptographic software written by eric young
python; 50; psf hereby grants; psf hereby grants licensee a nonexclusive royalty free world ?wide {L} to reproduce analyze test perform
python; 50; python software foundation; this {L} agreement is between the python software foundation psf and the individual or organization
php; 50; the name php; the name php must not be used to endorse or promote products derived from this software
postgresql; 50; without a written agreement; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
vim; 50; charityware; vim is charityware you can use and copy it as much as you like
ms-pl; 50; accompanying software; this {L} governs use of the accompanying software if you use the software you accept this {L}
ms-rl; 50; for any file you distribute; for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file along with a copy of this {L}
cecill; 50; under french law; this software is governed by the cecill (?:[abc] )?{L} under french law
sgi-b; 50; dates of first publication; the above copyright notice including the dates of first publication and either this permission notice or a reference to
odbl; 50; open database; is made available under the open database {L}
odbl; 50; database contents; any rights in individual contents of the database are licensed under the database contents {L}
ogl; 50; public sector information; contains public sector information licensed under the open government {L}
busl; 50; non production use; the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic; 50; hosted or managed service; you may not provide the software to third parties as a hosted or managed service
sspl; 50; service source code; available to third parties as a service you must make the service source code available
commons-clause; 50; right to sell the software; the grant of rights under the {L} will not include and the {L} does not grant to you the right to sell the software
llama; 50; llama; is licensed under the llama \d(?: \d)? community {L}
openrail; 50; responsible ai; (?:open |openrail )?responsible ai {L}
proprietary; 50; may be reproduced; no part of this (?:publication|book|document|software|program) may be reproduced
proprietary; 50; duplication or disclosure; use duplication or disclosure by the (?:u s )?government is subject to restrictions
proprietary; 50; decompile; you may not (?:modify )?reverse engineer decompile or disassemble
proprietary; 50; licensed materials; licensed materials property of [a-z0-9]+
proprietary; 50; redistribution; reproduction or redistribution (?:in whole or in part )?without (?:prior |express )?(?:written )?permission is (?:strictly )?(?:prohibited|forbidden)
gpl; 40; general public; {by}(?:gnu )?general public {L}{v}{later}
gpl; 40; gpl; {by}(?:gnu )?gpl(?: ?v?[123])?{v}{later}
lgpl; 40; lesser general; {by}(?:gnu )?lesser general public {L}{v}{later}
lgpl; 40; library general; {by}(?:gnu )?library general public {L}{v}{later}
lgpl; 40; lgpl; {by}(?:gnu )?lgpl{v}{later}
agpl; 40; affero; {by}(?:gnu )?affero general public {L}{v}{later}
agpl; 40; agpl; {by}(?:gnu )?agpl{v}{later}
gfdl; 40; free documentation; {by}(?:gnu )?free documentation {L}{v}{later}
apache; 40; apache; {by}apache (?:software )?{L}{v}
mpl; 40; mozilla public; {by}mozilla public {L}{v}
epl; 40; eclipse public; {by}eclipse public {L}{v}
cddl; 40; common development; {by}common development and distribution {L}{v}
artistic; 40; artistic; {by}artistic {L}{v}
boost; 40; boost software; {by}boost software {L}{v}
eupl; 40; european union public; {by}european union public {L}{v}
ofl; 40; open font; {by}(?:sil )?open font {L}{v}
cc-by; 40; creative commons attribution; {by}creative commons attribution(?: \d \d)?(?: international| unported| generic)? {L}
cc-by-sa; 40; creative commons attribution; {by}creative commons attribution share ?alike(?: \d \d)?(?: international| unported| generic)? {L}
cc-by-nc; 40; creative commons attribution; {by}creative commons attribution non ?commercial(?: \d \d)?(?: international| unported| generic)? {L}
cc-by-nc-sa; 40; creative commons attribution; {by}creative commons attribution non ?commercial share ?alike(?: \d \d)?(?: international| unported| generic)? {L}
cc-by-nd; 40; creative commons attribution; {by}creative commons attribution no ?deriv(?:s|atives)(?: \d \d)?(?: international| unported| generic)? {L}
cc-by-nc-nd; 40; creative commons attribution; {by}creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: \d \d)?(?: international| unported| generic)? {L}
cc0; 40; creative commons zero; {by}creative commons zero{v}
gpl; 35; gpl; {tag}(?:gnu )?gpl{id}
gpl; 35; gpl; {also}gpl{id}
gpl; 35; gplv; {tag}(?:gnu )?gplv[123]
lgpl; 35; lgpl; {tag}(?:gnu )?lgpl{id}
lgpl; 35; lgpl; {also}lgpl{id}
agpl; 35; agpl; {tag}(?:gnu )?agpl{id}
agpl; 35; agpl; {also}agpl{id}
gfdl; 35; gfdl; {tag}(?:gnu )?gfdl{id}
apache; 35; apache; {tag}apache v?(?:2|1 [01])(?: 0)?
apache; 35; apache; {also}apache (?:2|1)(?: [01])?
apache; 35; asl; {tag}asl (?:2|1)(?: [01])?
mit; 35; mit; {tag}mit
mit; 35; mit; {also}mit
mit-0; 35; mit 0; {tag}mit 0
mit; 35; expat; {tag}expat
x11; 35; x11; {tag}x11
bsd; 35; bsd; {tag}bsd
bsd; 35; bsd; {also}bsd
bsd-2-clause; 35; bsd 2 clause; {tag}bsd 2 clause(?: freebsd| netbsd| patent)?
bsd-2-clause; 35; bsd 2 clause; {also}bsd 2 clause
bsd-3-clause; 35; bsd 3 clause; {tag}bsd 3 clause(?: clear| lbnl)?
bsd-3-clause; 35; bsd 3 clause; {also}bsd 3 clause
bsd-4-clause; 35; bsd 4 clause; {tag}bsd 4 clause
0bsd; 35; 0bsd; {tag}0bsd
isc; 35; isc; {tag}isc
isc; 35; isc; {also}isc
mpl; 35; mpl; {tag}mpl{id}
mpl; 35; mpl; {also}mpl{id}
epl; 35; epl; {tag}epl{id}
epl; 35; epl; {also}epl{id}
cddl; 35; cddl; {tag}cddl{id}
cpl; 35; cpl; {tag}cpl 1(?: 0)?
ipl; 35; ipl; {tag}ipl 1(?: 0)?
artistic; 35; artistic; {tag}artistic [12](?: 0)?(?: perl)?
zlib; 35; zlib; {tag}zlib
libpng; 35; libpng; {tag}libpng(?: 2 0)?
boost; 35; bsl; {tag}bsl 1 0
boost; 35; bsl; {also}bsl 1 0
busl; 35; busl; {tag}busl 1 1
unlicense; 35; unlicense; {tag}unlicense
wtfpl; 35; wtfpl; {tag}wtfpl
eupl; 35; eupl; {tag}eupl{id}
ofl; 35; ofl; {tag}(?:sil )?ofl{id}
python; 35; python; {tag}python 2 0(?: 1)?
python; 35; psf; {tag}psf 2 0
php; 35; php; {tag}php 3 0(?: ?1)?
postgresql; 35; postgresql; {tag}postgresql
openssl; 35; openssl; {tag}openssl
odbl; 35; odbl; {tag}odbl{id}
odc-by; 35; odc by; {tag}odc by(?: 1 0)?
pddl; 35; pddl; {tag}pddl(?: 1 0)?
ms-pl; 35; ms pl; {tag}ms pl
ms-rl; 35; ms rl; {tag}ms rl
afl; 35; afl; {tag}afl{id}
osl; 35; osl; {tag}osl{id}
ecl; 35; ecl; {tag}ecl{id}
ncsa; 35; ncsa; {tag}ncsa
upl; 35; upl; {tag}upl 1 0
blueoak; 35; blueoak; {tag}blueoak 1 0 0
mulan; 35; mulanpsl; {tag}mulanpsl [12](?: 0)?
cecill; 35; cecill; {tag}cecill(?: b| c)?{id}
w3c; 35; w3c; {tag}w3c(?: \d{8})?
json; 35; json; {tag}json license
vim; 35; vim; {tag}vim license
ruby; 35; ruby; {tag}ruby license
qpl; 35; qpl; {tag}qpl 1 0
sleepycat; 35; sleepycat; {tag}sleepycat
curl; 35; curl; {tag}curl license
ftl; 35; ftl; {tag}ftl
ijg; 35; ijg; {tag}ijg
unicode; 35; unicode; {tag}unicode (?:dfs|tou|3 0)
ntp; 35; ntp; {tag}ntp license
hpnd; 35; hpnd; {tag}hpnd
sspl; 35; sspl; {tag}sspl 1 0
elastic; 35; elastic; {tag}elastic 2 0
cpal; 35; cpal; {tag}cpal 1 0
watcom; 35; watcom; {tag}watcom 1 0
nasa; 35; nasa; {tag}nasa 1 3
ogl; 35; ogl uk; {tag}ogl uk [123] 0
etalab; 35; etalab; {tag}etalab 2 0
cc0; 35; cc0; {tag}cc0{id}
cc0; 35; cc0; {also}cc0{id}
cc-by; 35; cc by; {tag}cc by{id}
cc-by-sa; 35; cc by sa; {tag}cc by sa{id}
cc-by-nc; 35; cc by nc; {tag}cc by nc{id}
cc-by-nd; 35; cc by nd; {tag}cc by nd{id}
cc-by-nc-sa; 35; cc by nc sa; {tag}cc by nc sa{id}
cc-by-nc-nd; 35; cc by nc nd; {tag}cc by nc nd{id}
public-domain; 35; public domain; {tag}public domain
proprietary; 35; proprietary; {tag}proprietary
proprietary; 35; licenseref; spdx license identifier licenseref proprietary
proprietary; 35; unlicensed; {tag}unlicensed
gpl; 30; general public; {by}(?:gnu )?general public {L}
gpl; 30; gpl; {by}(?:gnu )?gpl
lgpl; 30; lesser general; {by}(?:gnu )?lesser general public {L}
lgpl; 30; lgpl; {by}(?:gnu )?lgpl
agpl; 30; affero; {by}(?:gnu )?affero general public {L}
agpl; 30; agpl; {by}(?:gnu )?agpl
gfdl; 30; free documentation; {by}(?:gnu )?free documentation {L}
apache; 30; apache; {by}apache (?:software )?{L}
mit; 30; mit; {by}(?:the )?mit (?:style )?{L}
mit; 30; expat; {by}expat {L}
x11; 30; x11; {by}x11 {L}
bsd; 30; bsd; {by}(?:modified |new |revised |simplified )?bsd (?:style )?{L}
bsd-2-clause; 30; bsd 2 clause; {by}bsd 2 clause(?: {L})?
bsd-2-clause; 30; 2 clause bsd; {by}2 clause bsd(?: {L})?
bsd-3-clause; 30; bsd 3 clause; {by}bsd 3 clause(?: {L})?
bsd-3-clause; 30; 3 clause bsd; {by}3 clause bsd(?: {L})?
isc; 30; isc; {by}isc {L}
mpl; 30; mozilla public; {by}mozilla public {L}
epl; 30; eclipse public; {by}eclipse public {L}
cddl; 30; common development; {by}common development and distribution {L}
cpl; 30; common public; {by}common public {L}
ipl; 30; ibm public; {by}ibm public {L}
artistic; 30; artistic; {by}artistic {L}
zlib; 30; zlib; {by}zlib (?:libpng )?{L}
boost; 30; boost software; {by}boost software {L}
busl; 30; business source; {by}business source {L}
unlicense; 30; unlicense; {by}unlicense
wtfpl; 30; wtfpl; {by}wtfpl
eupl; 30; european union public; {by}european union public {L}
ofl; 30; open font; {by}(?:sil )?open font {L}
python; 30; python; {by}python (?:software foundation )?{L}
php; 30; php; {by}php {L}
postgresql; 30; postgresql; {by}postgresql {L}
openssl; 30; openssl; {by}(?:dual )?openssl (?:and ssleay )?{L}
odbl; 30; open; {by}open (?:data commons open )?database {L}
odc-by; 30; open data commons attribution; {by}open data commons attribution {L}
ms-pl; 30; microsoft public; {by}microsoft public {L}
ms-rl; 30; microsoft reciprocal; {by}microsoft reciprocal {L}
afl; 30; academic free; {by}academic free {L}
osl; 30; open software; {by}open software {L}
ecl; 30; educational community; {by}educational community {L}
ncsa; 30; university of illinois; {by}university of illinois ncsa open source {L}
cc0; 30; cc0; {by}(?:creative commons )?cc0
cc-by; 30; cc by; {by}cc by
cc-by-sa; 30; cc by sa; {by}cc by sa
cc-by-nc; 30; cc by nc; {by}cc by nc
cc-by-nd; 30; cc by nd; {by}cc by nd
cc-by-nc-sa; 30; cc by nc sa; {by}cc by nc sa
public-domain; 30; public domain; (?:released|dedicated|donated|placed) (?:in|into|to) the public domain
proprietary; 30; proprietary; {by}proprietary {L}
gpl; 20; general public; (?:gnu )?general public {L}{v}{later}
gpl; 20; gpl; (?:gnu )?gpl{v}{later}
lgpl; 20; lesser general; (?:gnu )?lesser general public {L}{v}{later}
lgpl; 20; library general; (?:gnu )?library general public {L}{v}{later}
lgpl; 20; lgpl; (?:gnu )?lgpl{v}{later}
agpl; 20; affero; (?:gnu )?affero general public {L}{v}{later}
agpl; 20; agpl; (?:gnu )?agpl{v}{later}
gfdl; 20; free documentation; (?:gnu )?free documentation {L}{v}{later}
apache; 20; apache; apache (?:software )?{L}{v}
mpl; 20; mozilla public; mozilla public {L}{v}
epl; 20; eclipse public; eclipse public {L}{v}
cddl; 20; common development; common development and distribution {L}{v}
artistic; 20; artistic; artistic {L}{v}
eupl; 20; european union public; european union public {L}{v}
ofl; 20; open font; (?:sil )?open font {L}{v}
gpl; 15; general public; {see}(?:gnu )?general public {L}
lgpl; 15; lesser general; {see}(?:gnu )?lesser general public {L}
agpl; 15; affero; {see}(?:gnu )?affero general public {L}
apache; 15; apache; {see}apache (?:software )?{L}
mit; 15; mit; {see}mit {L}
bsd; 15; bsd; {see}bsd {L}
mpl; 15; mozilla public; {see}mozilla public {L}
epl; 15; eclipse public; {see}eclipse public {L}
isc; 15; isc; {see}isc {L}
gpl; 10; general public; (?:gnu )?general public {L}
gpl; 10; gpl; (?:gnu )?gpl
gpl; 10; gplv; (?:gnu )?gplv[123]
lgpl; 10; lesser general; (?:gnu )?lesser general public {L}
lgpl; 10; library general; (?:gnu )?library general public {L}
lgpl; 10; lgpl; (?:gnu )?lgpl(?:v[23])?
agpl; 10; affero; (?:gnu )?affero general public {L}
agpl; 10; agpl; (?:gnu )?agpl(?:v3)?
gfdl; 10; free documentation; (?:gnu )?free documentation {L}
apache; 10; apache; apache (?:software )?{L}
mit; 10; mit; (?:the )?mit {L}
mit; 10; expat; expat {L}
x11; 10; x11; x11 {L}
bsd; 10; bsd; bsd (?:style )?{L}
bsd-2-clause; 10; bsd 2 clause; bsd 2 clause
bsd-2-clause; 10; two clause bsd; two clause bsd
bsd-3-clause; 10; bsd 3 clause; bsd 3 clause
bsd-3-clause; 10; three clause bsd; three clause bsd
isc; 10; isc; isc {L}
mpl; 10; mozilla public; mozilla public {L}
epl; 10; eclipse public; eclipse public {L}
cddl; 10; common development; common development and distribution {L}
cpl; 10; common public; common public {L}
ipl; 10; ibm public; ibm public {L}
artistic; 10; artistic; artistic {L}
zlib; 10; zlib; zlib (?:libpng )?{L}
boost; 10; boost software; boost software {L}
busl; 10; business source; business source {L}
unlicense; 10; unlicense; (?:the )?unlicense
wtfpl; 10; wtfpl; wtfpl
eupl; 10; european union public; european union public {L}
ofl; 10; open font; (?:sil )?open font {L}
python; 10; python; python (?:software foundation )?{L}
php; 10; php; php {L}
postgresql; 10; postgresql; postgresql {L}
openssl; 10; openssl; openssl {L}
odbl; 10; open database; open database {L}
odbl; 10; open data commons; open data commons (?:open )?database {L}
odc-by; 10; open data commons; open data commons attribution {L}
pddl; 10; open data commons; open data commons public domain dedication and {L}
ms-pl; 10; microsoft public; microsoft public {L}
ms-rl; 10; microsoft reciprocal; microsoft reciprocal {L}
afl; 10; academic free; academic free {L}
osl; 10; open software; open software {L}
ecl; 10; educational community; educational community {L}
upl; 10; universal permissive; universal permissive {L}
mulan; 10; mulan permissive; mulan permissive software {L}
cecill; 10; cecill; cecill {L}
sspl; 10; server side public; server side public {L}
elastic; 10; elastic; elastic {L}
watcom; 10; sybase open watcom; sybase open watcom public {L}
nasa; 10; nasa open source; nasa open source agreement
ogl; 10; open government; open government {L}
cc0; 10; cc0; (?:creative commons )?cc0
cc0; 10; creative commons zero; creative commons zero
cc-by; 10; creative commons attribution; creative commons attribution(?: \d \d)?(?: international| unported| generic)? {L}
cc-by-sa; 10; creative commons attribution; creative commons attribution share ?alike
cc-by-nc; 10; creative commons attribution; creative commons attribution non ?commercial
cc-by-nc-sa; 10; creative commons attribution; creative commons attribution non ?commercial share ?alike
cc-by-nd; 10; creative commons attribution; creative commons attribution no ?deriv(?:s|atives)
cc-by; 10; cc by; cc by
cc-by-sa; 10; cc by sa; cc by sa
cc-by-nc; 10; cc by nc; cc by nc
cc-by-nd; 10; cc by nd; cc by nd
cc-by-nc-sa; 10; cc by nc sa; cc by nc sa
cc-by-nc-nd; 10; cc by nc nd; cc by nc nd
public-domain; 10; public domain; public domain
"""
#: Strings of which every expression's match holds at least one.
GATES = ["licen", "gpl", "wtfpl", "cc0", "cc by", "creative commons", "public domain", "permission", "redistribut", "neither the name", "proprietary", "all rights reserved", "what the fuck", "provided as is", "bsd", "copyright", "advertising", "altered source", "copied", "this product includes", "making python", "in no event shall", "software shall be used", "good and not evil", "unauthorized copying", "nasa open source", "precise terms", "interacting with it remotely", "network server software", "invariant sections", "views and conclusions", "must not be misrepresented", "copy of the mpl", "cddl header", "verbatim copies", "anyone is free to copy", "creativecommons", "reserved font name", "endorse or promote", "charityware", "hosted or managed service", "service source code", "may be reproduced", "duplication or disclosure", "decompile or disassemble"]


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(number, keyword, expression, label, priority, confidence) of every rule, in order."""
    out = []
    for i, line in enumerate(RULES.strip().split("\n")):
        label, priority, keyword, expression = line.split("; ", 3)
        for short, long in SHORT.items():
            expression = expression.replace(short, long)
        out.append((i, f" {keyword}", rf"(?<= )(?:{expression})(?= )", label, int(priority), SURE[int(priority)]))
    return out


def normalised(text: Column) -> Column:
    """Lower-cased words, each between single spaces; a single space if there are none."""
    a_z = "abcdefghijklmnopqrstuvwxyz"
    low = F.translate(F.coalesce(text, F.lit("")), a_z.upper(), a_z)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _words(c: Column) -> Column:
    """Words of a text that begins and ends in a space."""
    return F.greatest(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) - 1, F.lit(0)).cast("bigint")


def _rule_table() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(kw).alias("keyword"), F.lit(x).alias("expr"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(sure).alias("confidence")) for i, kw, x, label, p, sure in rules()])


def _spans(norm: Column, r: Column) -> Column:
    """Places of a rule's matches, as word ranges."""
    found = F.regexp_extract_all(norm, r["expr"], F.lit(0))
    gaps = F.split(norm, r["expr"], -1)
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"), F.lit(0).cast("bigint").alias("at"))
    count = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("bigint")
    step = lambda acc, p: F.struct(F.lit("").alias("text"), F.array_append(acc["out"], F.struct((acc["at"] + count(p["gap"]) - 1).alias("start"), (acc["at"] + count(p["gap"]) + count(p["hit"])).alias("end"))).alias("out"), (acc["at"] + count(p["gap"]) + count(p["hit"])).alias("at"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``detections``, ``labels`` and ``score``.

    ``detections`` holds the rules' word ranges (end exclusive) with label, rule, priority and confidence that remain
    after suppression. ``labels`` joins their labels and the base ones. ``score`` is the largest confidence, 0.5 at
    least if a base phrase occurs and 0 if nothing does. A null or empty text has no words and no labels. Other columns
    stay; one that has the name of an added column is replaced. An empty table gives no rows.
    """
    norm, twice = F.col("norm__"), F.col("twice__")
    added = {"n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score"}
    kept = [c for c in docs.columns if c.lower() not in added | {"norm__", "twice__", "places__", "raw__"}]
    out = docs.select(*kept, normalised(F.col(text)).alias("norm__"))
    # Every word between two spaces of its own, so that neighbouring phrases don't share one.
    out = out.withColumn("twice__", F.when(F.contains(norm, F.lit("license")) | F.contains(norm, F.lit("cc by")), F.replace(norm, F.lit(" "), F.lit("  "))).otherwise(F.lit("")))

    def place(phrase: str, label: str) -> Column:
        p = F.lit(f" {'  '.join(phrase.split())} ")
        n = ((F.length(twice) - F.length(F.replace(twice, p, F.lit("")))) / len(f" {'  '.join(phrase.split())} ")).cast("bigint")
        words = lambda c: F.floor((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("bigint")
        head, tail = F.substring_index(twice, f" {'  '.join(phrase.split())} ", 1), F.substring_index(twice, f" {'  '.join(phrase.split())} ", -1)
        return F.struct(F.lit(label).alias("label"), n.alias("n"), words(head).alias("first"), (words(twice) - 1 - len(phrase.split()) - words(tail)).alias("last"))

    out = out.withColumn("places__", F.when(twice != "", F.filter(F.array(*[F.when(F.contains(twice, F.lit(f" {'  '.join(p.split())} ")), place(p, label)) for p, label in BASE]), lambda x: x.isNotNull())))
    # Few texts hold any gate word (every keyword contains one), so the table of rules is looked at for few.
    any_keyword = reduce(or_, [F.contains(norm, F.lit(w)) for w in GATES])
    gated = F.filter(_rule_table(), lambda r: F.contains(norm, r["keyword"]))
    hits = F.flatten(F.transform(gated, lambda r: F.transform(_spans(norm, r), lambda s: F.struct(s["start"], s["end"], r["label"].alias("label"), r["rule"].alias("rule"), r["priority"].alias("priority"), r["confidence"].alias("confidence")))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string,rule:int,priority:int,confidence:double>>")
    out = out.withColumn("raw__", F.when(any_keyword, hits).otherwise(none))
    inside = lambda s, o: (o["start"] <= s["start"]) & (o["end"] >= s["end"])
    above = lambda s, o: (o["priority"] > s["priority"]) | ((o["priority"] == s["priority"]) & (((o["end"] - o["start"]) > (s["end"] - s["start"])) | (((o["end"] - o["start"]) == (s["end"] - s["start"])) & (o["rule"] < s["rule"]))))
    out = out.withColumn("detections", F.array_sort(F.filter(F.col("raw__"), lambda s: ~F.exists(F.col("raw__"), lambda o: inside(s, o) & above(s, o)))))
    base = F.coalesce(F.col("places__"), F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>"))
    base_labels = F.transform(base, lambda x: x["label"])
    out = out.withColumn("n_words", _words(norm)).withColumn("n_base", F.aggregate(base, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]))
    out = out.withColumn("first_word", F.array_min(F.transform(base, lambda x: x["first"]))).withColumn("last_word", F.array_max(F.transform(base, lambda x: x["last"])))
    out = out.withColumn("base_labels", F.array_join(F.array_sort(F.array_distinct(base_labels)), ","))
    out = out.withColumn("labels", F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("detections", lambda d: d["label"])))), ","))
    sure = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    out = out.withColumn("score", F.greatest(sure, F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)))
    return out.drop("norm__", "twice__", "places__", "raw__")
