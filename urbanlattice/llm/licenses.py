"""Licence scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A text is folded once to `` w1 w2 ... wn `` (ASCII lower case, single spaces). One
Aho-Corasick pass over it finds the keywords; only rules whose keyword occurs run
their regular expression. A detection that lies within a kept detection of higher
priority (or of the same priority and greater length) is suppressed.

Null or empty text: no words and no detections. Rows are scanned each by their own
text: repeated rows, and rows that share an id or have none, give as many results. Texts
are read whole, however long. Other columns are left aside, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str  # occurs in every text that ``pattern`` matches
    pattern: str  # over words with single spaces
    priority: int
    confidence: float
    base: bool = False


#: Phrases whose places are always counted.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label | keyword | name in running text | identifier in the words of a tag line
LICENSES = """
gpl-2.0 | gpl | (?:gnu )?gpl (?:version |v)?2(?: 0)?|gplv2 | gpl 2 0(?: only| or later)?
gpl-3.0 | gpl | (?:gnu )?gpl (?:version |v)?3(?: 0)?|gplv3 | gpl 3 0(?: only| or later)?
gpl-2.0 | gnu general public license | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)2(?: 0)? | gnu general public license 2 0
gpl-3.0 | gnu general public license | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)? | gnu general public license 3 0
lgpl | lesser general public license | gnu lesser general public license(?: (?:version |v)?(?:2 1|2|3)(?: 0)?)? | lesser general public license
lgpl | library general public license | gnu library general public license(?: (?:version |v)?2(?: 0)?)? | library general public license
lgpl | lgpl | (?:gnu )?lgpl(?: (?:version |v)?(?:2 1|2 0|3 0|2|3))? | lgpl (?:2 0|2 1|3 0)(?: only| or later)?
agpl | affero general public license | gnu affero general public license(?: (?:version |v)?3(?: 0)?)? | affero general public license
agpl | agpl | (?:gnu )?agpl(?: (?:version |v)?3(?: 0)?)? | agpl 3 0(?: only| or later)?
gfdl | free documentation license | gnu free documentation license(?: (?:version |v)?1 [123])? | gfdl 1 [123](?: only| or later)?
apache-1.1 | apache | apache (?:software )?license (?:version |v)?1 1 | apache 1 1
apache-2.0 | apache | apache (?:software )?license (?:version |v)?2(?: 0)? | apache 2 0
mit | mit | mit(?: x11)? license|mit licence | mit
mit | expat | expat licen[cs]e | expat
bsd-2-clause | bsd | (?:simplified |2 clause |two clause )bsd license|bsd 2 clause(?: license)? | bsd 2 clause
bsd-3-clause | bsd | (?:new |modified |revised |3 clause |three clause )bsd license|bsd 3 clause(?: license)? | bsd 3 clause
bsd | bsd | bsd (?:style )?licen[cs]e | bsd 4 clause
mpl-1.1 | mozilla public license | mozilla public license (?:version |v)?1 1 | mpl 1 1
mpl-2.0 | mozilla public license | mozilla public license(?: (?:version |v)?2(?: 0)?)? | mozilla public license 2 0
mpl-2.0 | mpl | mpl (?:version |v)?2(?: 0)? | mpl 2 0
epl | eclipse public license | eclipse public license(?: (?:version |v)?[12](?: 0)?)? | eclipse public license
cddl | common development and distribution license | common development and distribution license(?: (?:version |v)?1 [01])? | common development and distribution license
eupl | european union public licen | european union public licen[cs]e(?: (?:version |v)?1 [012])? | european union public licence
artistic | artistic license | (?:perl )?artistic license(?: (?:version |v)?[12](?: 0)?)? | artistic license 2 0
isc | isc | isc licen[cs]e | isc
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib
boost | boost software license | boost software license(?: (?:version |v)?1 0)? | boost software license
unlicense | unlicense | the unlicense | unlicense
wtfpl | wtfpl | wtfpl(?: (?:version |v)?2)? | wtfpl
python | python software foundation license | python software foundation license(?: (?:version |v)?2)? | python software foundation license
php | php license | php license(?: (?:version |v)?3 0[01]?)? | php license
ruby | ruby license | ruby license | ruby license
openssl | openssl license | openssl license | openssl license
postgresql | postgresql licen | postgresql licen[cs]e | postgresql license
odbl | database license | open (?:data commons )?(?:open )?database license(?: (?:version |v)?1 0)? | open database license
odbl | odbl | odbl(?: (?:version |v)?1 0)? | odbl 1 0
ofl | open font license | (?:sil )?open font license(?: (?:version |v)?1 [01])? | open font license
cc0 | cc0 | cc0(?: (?:version |v)?1 0)?(?: universal)? | cc0 1 0
cc-by | cc by | cc by(?: (?:version |v)?[1234](?: [05])?)? | cc by [1234] [05]
cc-by-sa | cc by sa | cc by sa(?: (?:version |v)?[1234](?: [05])?)? | cc by sa [1234] [05]
cc-by-nd | cc by nd | cc by nd(?: (?:version |v)?[1234](?: [05])?)? | cc by nd [1234] [05]
cc-by-nc | cc by nc | cc by nc(?: (?:version |v)?[1234](?: [05])?)? | cc by nc [1234] [05]
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: (?:version |v)?[1234](?: [05])?)? | cc by nc sa [1234] [05]
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: (?:version |v)?[1234](?: [05])?)? | cc by nc nd [1234] [05]
cc-by | creative commons attribution | creative commons attribution(?: (?:version |v)?[1234](?: [05])?)?(?: (?:international|unported))?(?: licen[cs]e)? | creative commons attribution
cc-by-sa | creative commons attribution share | creative commons attribution share ?alike(?: [1234] [05])?(?: (?:international|unported))?(?: licen[cs]e)? | creative commons attribution share ?alike
cc-by-nc | creative commons attribution non | creative commons attribution non ?commercial(?: [1234] [05])?(?: (?:international|unported))?(?: licen[cs]e)? | creative commons attribution non ?commercial
cc-by-nd | creative commons attribution no | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: licen[cs]e)? | creative commons attribution no ?derivs
ogl | open government licen | open government licen[cs]e(?: (?:version |v)?[123](?: 0)?)? | open government licence
afl | academic free license | academic free license(?: (?:version |v)?3 0)? | academic free license
ms-pl | microsoft public license | microsoft public license | microsoft public license
""".strip()

#: Ways in which a notice introduces a licence: pattern, priority, confidence.
NOTICES = [
    (r"(?:is |are )?licensed under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})", 50, 0.98),
    (r"(?:is |are )?(?:released|distributed|published|available|provided) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})", 50, 0.97),
    (r"(?:see|read|under|subject to) (?:the )?(?:terms of )?(?:the )?(?:{name}) for (?:more )?details", 45, 0.9),
    (r"spdx license identifier (?:{tag})", 60, 1.0),
    (r"(?:{name})", 30, 0.8),
]

#: name | label | keyword | pattern | priority | confidence: sentences of licence texts and of notices.
CLAUSES = r"""
mit-grant | mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy | 70 | 0.97
isc-grant | isc | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | 70 | 0.97
bsd-grant | bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted | 70 | 0.95
bsd-endorse | bsd-3-clause | endorse or promote products derived | neither the name of .{0,80}? may be used to endorse or promote products derived | 72 | 0.95
gpl-grant | gpl | free software you can redistribute it | free software you can redistribute it and or modify it under the terms of the gnu general public license | 70 | 0.98
lgpl-grant | lgpl | free software you can redistribute it | free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license | 71 | 0.98
agpl-grant | agpl | free software you can redistribute it | free software you can redistribute it and or modify it under the terms of the gnu affero general public license | 71 | 0.98
gpl-later | gpl-or-later | or at your option any later version | or at your option any later version | 55 | 0.7
apache-grant | apache-2.0 | you may not use this file except in compliance with the license | you may not use this file except in compliance with the license | 70 | 0.95
apache-asis | apache-2.0 | distributed on an as is basis | distributed on an as is basis without warranties or conditions of any kind | 65 | 0.9
mpl-grant | mpl-2.0 | subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0 | 70 | 0.98
unlicense-grant | unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain | 70 | 0.98
zlib-grant | zlib | this software is provided as is without any express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable | 70 | 0.95
boost-grant | boost | distributed under the boost software license | distributed under the boost software license version 1 0 | 70 | 0.98
public-domain | public-domain | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain|in the public domain | 40 | 0.8
reserved | all-rights-reserved | all rights reserved | all rights reserved | 20 | 0.6
proprietary | proprietary | proprietary | proprietary and confidential|confidential and proprietary | 40 | 0.7
cc-generic | cc | creative commons | creative commons licen[cs]e | 25 | 0.6
no-derivatives | no-derivatives | no derivative works | no derivative works (?:are )?(?:allowed|permitted) | 25 | 0.5
non-commercial | non-commercial | non commercial use only | (?:for )?non commercial use only | 25 | 0.5
mit-notice | mit | copyright notice and this permission notice shall be included | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | 68 | 0.97
mit-warranty | mit | the software is provided as is without warranty of any kind | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability | 60 | 0.9
mit-liability | mit | in no event shall the authors or copyright holders be liable | in no event shall the authors or copyright holders be liable for any claim damages or other liability | 58 | 0.9
x11-names | x11 | shall not be used in advertising or otherwise to promote | except as contained in this notice the names? of .{0,80}? shall not be used in advertising or otherwise to promote the sale use or other dealings | 71 | 0.95
mit-0 | mit-0 | deal in the software without restriction including | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software | 66 | 0.9
bsd-source | bsd | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer | 68 | 0.95
bsd-binary | bsd | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer | 68 | 0.95
bsd-advertising | bsd-4-clause | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment | 73 | 0.97
bsd-warranty | bsd | provided by the copyright holders and contributors as is | this software is provided by the copyright holders and contributors as is and any express or implied warranties | 60 | 0.9
bsd-regents | bsd | provided by the regents and contributors as is | this software is provided by the regents and contributors as is and any express or implied warranties | 61 | 0.92
bsd-liability | bsd | be liable for any direct indirect incidental special | in no event shall .{0,60}? be liable for any direct indirect incidental special exemplary or consequential damages | 55 | 0.85
bsd-views | bsd-2-clause | the views and conclusions contained in the software | the views and conclusions contained in the software and documentation are those of the authors | 56 | 0.85
bsd-patent | bsd-2-clause-patent | subject to the terms and conditions of this license each copyright holder | subject to the terms and conditions of this license each copyright holder and contributor hereby grants | 64 | 0.9
bsd-clear | bsd-3-clause-clear | no express or implied licenses to any party s patent rights | no express or implied licenses to any party s patent rights are granted by this license | 73 | 0.95
gpl-hope | gpl | distributed in the hope that it will be useful | distributed in the hope that it will be useful but without any warranty | 52 | 0.85
gpl-copy | gpl | you should have received a copy of the gnu general public license | you should have received a copy of the gnu general public license along with this (?:program|software|file|package|library) | 62 | 0.95
gpl-see | gpl | see the gnu general public license for more details | see the gnu general public license for more details | 62 | 0.95
lgpl-copy | lgpl | you should have received a copy of the gnu lesser general public license | you should have received a copy of the gnu lesser general public license along with this (?:program|software|file|package|library) | 63 | 0.95
lgpl-see | lgpl | see the gnu lesser general public license for more details | see the gnu lesser general public license for more details | 63 | 0.95
lgpl-library-copy | lgpl | you should have received a copy of the gnu library general public license | you should have received a copy of the gnu library general public license along with this (?:program|software|file|package|library) | 63 | 0.95
agpl-copy | agpl | you should have received a copy of the gnu affero general public license | you should have received a copy of the gnu affero general public license along with this (?:program|software|file|package|library) | 63 | 0.95
agpl-see | agpl | see the gnu affero general public license for more details | see the gnu affero general public license for more details | 63 | 0.95
agpl-network | agpl-3.0 | remote network interaction use with the gnu general public license | remote network interaction use with the gnu general public license | 66 | 0.95
gpl-preamble | gpl | designed to take away your freedom to share and change | the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change | 66 | 0.95
gpl-copies | gpl | everyone is permitted to copy and distribute verbatim copies | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed | 50 | 0.8
gpl-2-only | gpl-2.0 | under the terms of version 2 of the | under the terms of version 2 of the (?:gnu general public )?license | 57 | 0.85
gpl-2-title | gpl-2.0 | gnu general public license version 2 june 1991 | gnu general public license version 2 june 1991 | 69 | 0.98
gpl-3-title | gpl-3.0 | gnu general public license version 3 29 june 2007 | gnu general public license version 3 29 june 2007 | 69 | 0.98
lgpl-2.1-title | lgpl-2.1 | gnu lesser general public license version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999 | 69 | 0.98
lgpl-3-title | lgpl-3.0 | gnu lesser general public license version 3 29 june 2007 | gnu lesser general public license version 3 29 june 2007 | 69 | 0.98
agpl-3-title | agpl-3.0 | gnu affero general public license version 3 19 november 2007 | gnu affero general public license version 3 19 november 2007 | 69 | 0.98
gpl-classpath | gpl-classpath | as a special exception the copyright holders of this library | as a special exception the copyright holders of this library give you permission to link this library with independent modules | 72 | 0.95
gpl-bison | gpl-bison | as a special exception you may create a larger work | as a special exception you may create a larger work that contains part or all of the bison parser skeleton | 72 | 0.95
gpl-gcc | gpl-gcc | gcc runtime library exception | gcc runtime library exception | 65 | 0.95
gpl-autoconf | gpl-autoconf | as a special exception the free software foundation gives unlimited permission | as a special exception the free software foundation gives unlimited permission to copy distribute and modify | 71 | 0.9
gfdl-grant | gfdl | permission is granted to copy distribute and or modify this document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | 71 | 0.98
gfdl-sections | gfdl | with no invariant sections | with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts | 60 | 0.9
apache-copy | apache-2.0 | you may obtain a copy of the license at | you may obtain a copy of the license at http www apache org licenses license 2 0 | 71 | 0.98
apache-limits | apache-2.0 | see the license for the specific language governing permissions | see the license for the specific language governing permissions and limitations under the license | 65 | 0.92
apache-asf | apache-2.0 | licensed to the apache software foundation | licensed to the apache software foundation asf under one or more contributor license agreements | 71 | 0.97
apache-title | apache-2.0 | apache license version 2 0 january 2004 | apache license version 2 0 january 2004 | 72 | 0.99
apache-terms | apache-2.0 | terms and conditions for use reproduction and distribution | terms and conditions for use reproduction and distribution 1 definitions | 60 | 0.9
apache-1-thanks | apache-1.1 | this product includes software developed by the apache | this product includes software developed by the apache (?:software foundation|group) | 66 | 0.93
apache-1-names | apache-1.1 | must not be used to endorse or promote products derived | the names apache .{0,80}? must not be used to endorse or promote products derived | 70 | 0.93
mpl-1-grant | mpl-1.1 | subject to the mozilla public license version | the contents of this file are subject to the mozilla public license version 1 1 | 71 | 0.98
mpl-1-rights | mpl-1.1 | distributed under the license is distributed on an as is basis | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights | 66 | 0.92
mpl-2-copy | mpl-2.0 | if a copy of the mpl was not distributed with this file | if a copy of the mpl was not distributed with this file you can obtain one at | 71 | 0.98
mpl-2-secondary | mpl-2.0 | incompatible with secondary licenses | this source code form is incompatible with secondary licenses as defined by the mozilla public license | 66 | 0.93
epl-grant | epl | made available under the terms of the eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license | 71 | 0.98
epl-agreement | epl | the accompanying program is provided under the terms of this eclipse | the accompanying program is provided under the terms of this eclipse public license agreement | 70 | 0.98
cpl-agreement | cpl | the accompanying program is provided under the terms of this common | the accompanying program is provided under the terms of this common public license agreement | 70 | 0.98
cddl-grant | cddl | subject to the terms of the common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license | 71 | 0.98
eupl-grant | eupl | licensed under the eupl | licensed under the eupl(?: version 1 [012])? | 66 | 0.95
artistic-preamble | artistic | intent of this document is to state the conditions | the intent of this document is to state the conditions under which a package may be copied | 66 | 0.93
perl-same | perl | same terms as perl itself | (?:it )?under the same terms as perl itself | 62 | 0.9
isc-warranty | isc | the software is provided as is and the author disclaims | the software is provided as is and the author disclaims all warranties with regard to this software | 62 | 0.93
isc-notice | isc | provided that the above copyright notice and this permission notice appear | provided that the above copyright notice and this permission notice appear in all copies | 58 | 0.88
zlib-origin | zlib | the origin of this software must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software | 70 | 0.95
zlib-altered | zlib | altered source versions must be plainly marked as such | altered source versions must be plainly marked as such and must not be misrepresented as being the original software | 68 | 0.95
libpng-grant | libpng | permission is hereby granted to use copy modify and distribute this source code | permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee | 68 | 0.93
boost-grant-text | boost | obtaining a copy of the software and accompanying documentation | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation | 72 | 0.97
wtfpl-clause | wtfpl | you just do what the | 0 you just do what the \w+ you want to | 66 | 0.95
python-grant | python | individual or organization licensee accessing and otherwise using | individual or organization licensee accessing and otherwise using (?:this software|python) | 66 | 0.93
php-product | php | this product includes php software freely available from | this product includes php software freely available from http www php net software | 66 | 0.95
ruby-copy | ruby | you may make and give away verbatim copies of the source form | you may make and give away verbatim copies of the source form of the software without restriction | 60 | 0.88
openssl-product | openssl | developed by the openssl project for use in the openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit | 68 | 0.97
ssleay-product | openssl | includes cryptographic software written by eric young | this product includes cryptographic software written by eric young | 66 | 0.95
postgresql-grant | postgresql | software and its documentation for any purpose without fee and without a written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted | 71 | 0.97
ntp-grant | ntp | for any purpose with or without fee is hereby granted provided | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided | 69 | 0.93
hpnd-grant | hpnd | documentation for any purpose and without fee is hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted | 69 | 0.93
curl-grant | curl | software for any purpose with or without fee is hereby granted | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted | 66 | 0.9
ijg-thanks | ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group | 64 | 0.93
freetype-grant | freetype | the freetype project | portions of this software are copyright .{0,40}? the freetype project | 64 | 0.93
ofl-grant | ofl | this font software is licensed under the sil open font license | this font software is licensed under the sil open font license version 1 1 | 71 | 0.98
ofl-reserved | ofl | with reserved font name | with reserved font name | 58 | 0.85
odbl-grant | odbl | made available under the open database license | this .{0,60}? (?:is )?made available under the open database license | 70 | 0.97
pddl-grant | pddl | public domain dedication and license | (?:open data commons )?public domain dedication and license | 60 | 0.92
cc0-waiver | cc0 | to the extent possible under law | to the extent possible under law .{0,120}? waived all copyright and related or neighboring rights | 71 | 0.97
cc0-title | cc0 | cc0 1 0 universal | cc0 1 0 universal public domain dedication | 68 | 0.97
cc-by-grant | cc-by | licensed under a creative commons attribution 4 0 international license | this work is licensed under a creative commons attribution 4 0 international license | 71 | 0.98
cc-by-sa-grant | cc-by-sa | licensed under a creative commons attribution sharealike | this work is licensed under a creative commons attribution sharealike [1234] [05](?: international| unported)? license | 72 | 0.98
cc-by-nc-grant | cc-by-nc | licensed under a creative commons attribution noncommercial | this work is licensed under a creative commons attribution noncommercial [1234] [05](?: international| unported)? license | 72 | 0.98
cc-legal | cc | creative commons corporation is not a law firm | creative commons corporation is not a law firm and does not provide legal services | 60 | 0.9
cc-url | cc | creativecommons org licenses | creativecommons org licenses (?:by|by sa|by nd|by nc|by nc sa|by nc nd) [1234] [05] | 62 | 0.95
cc-zero-url | cc0 | creativecommons org publicdomain zero 1 0 | creativecommons org publicdomain zero 1 0 | 62 | 0.97
wikipedia-text | cc-by-sa | text is available under the creative commons | text is available under the creative commons attribution share ?alike license | 70 | 0.97
ogl-contains | ogl | contains public sector information licensed under the open government | contains public sector information licensed under the open government licen[cs]e | 71 | 0.98
ms-pl-terms | ms-pl | this license governs use of the accompanying software | this license governs use of the accompanying software if you use the software you accept this license | 62 | 0.9
ms-limited | ms-lpl | microsoft limited public license | microsoft limited public license | 55 | 0.85
json-evil | json | shall be used for good not evil | the software shall be used for good not evil | 72 | 0.99
beerware | beerware | you can buy me a beer in return | if we meet some day and you think this stuff is worth it you can buy me a beer in return | 70 | 0.98
vim-grant | vim | there are no restrictions on distributing unmodified copies of vim | there are no restrictions on distributing unmodified copies of vim | 66 | 0.97
qpl | qpl | the q public license | the q public license(?: version)?(?: 1 0)? | 60 | 0.93
ipl | ipl | ibm public license | ibm public license(?: version)?(?: 1 0)? | 58 | 0.92
npl | npl | netscape public license | netscape public license(?: version)?(?: 1 [01])? | 58 | 0.92
apsl | apsl | apple public source license | apple public source license(?: version)?(?: [12] 0)? | 58 | 0.93
osl | osl | open software license | open software license(?: version)?(?: [123] [01])? | 56 | 0.9
ecl | ecl | educational community license | educational community license(?: version)?(?: [12] 0)? | 58 | 0.92
upl | upl | universal permissive license | universal permissive license(?: v| version)?(?: 1 0)? | 58 | 0.93
bsl-source | busl | business source license | business source license(?: 1 1)? | 58 | 0.93
sspl | sspl | server side public license | server side public license(?: v(?:ersion)? ?1)? | 58 | 0.95
elastic | elastic | elastic license | elastic license(?: 2 0)? | 50 | 0.85
polyform | polyform | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) license | 60 | 0.93
openrail | openrail | openrail | (?:creativeml |bigscience )?openrail(?: m| d| s)?(?: license)? | 55 | 0.9
ai-rail-use | openrail | use based restrictions as referenced in paragraph 5 | use based restrictions as referenced in paragraph 5 | 64 | 0.93
nc-research | non-commercial | for non commercial research purposes only | for non commercial research purposes only | 45 | 0.75
evaluation-only | evaluation | for evaluation purposes only | for evaluation purposes only | 35 | 0.65
eula | eula | end user license agreement | end user license agreement | 30 | 0.65
all-rights-no-copy | all-rights-reserved | no part of this publication may be reproduced | no part of this publication may be reproduced (?:stored in a retrieval system or )?(?:distributed )?(?:or )?transmitted | 60 | 0.9
confidential | proprietary | contains confidential information | contains confidential information (?:of|belonging to|proprietary) | 45 | 0.75
gpl-without-warranty | gpl | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details | 64 | 0.95
gpl-received-copy | gpl | you should have received a copy of the gnu general public license | you should have received a copy of the gnu general public license along with | 66 | 0.96
lgpl-received-copy | lgpl | you should have received a copy of the gnu lesser general public license | you should have received a copy of the gnu lesser general public license along with | 66 | 0.96
agpl-received-copy | agpl | you should have received a copy of the gnu affero general public license | you should have received a copy of the gnu affero general public license along with | 66 | 0.96
agpl-network-text | agpl | an opportunity to receive the corresponding source of your version | offer all users interacting with it remotely through a computer network .{0,80}? an opportunity to receive the corresponding source of your version | 66 | 0.95
gpl-freedom | gpl | are designed to make sure that you have the freedom to distribute copies of free software | are designed to make sure that you have the freedom to distribute copies of free software | 56 | 0.88
gpl-take-away | gpl | intended to guarantee your freedom to share and change | intended to guarantee your freedom to share and change | 52 | 0.85
gpl-installation | gpl-3.0 | installation information for a user product means any methods procedures | installation information for a user product means any methods procedures | 62 | 0.93
gpl-linking | gpl | gives permission to link the code of portions of this program with the openssl library | gives permission to link the code of portions of this program with the openssl library | 64 | 0.92
gpl-classpath-text | gpl | linking this library statically or dynamically with other modules | linking this library statically or dynamically with other modules is making a combined work based on this library | 64 | 0.93
gpl-bison-text | gpl | you may create a larger work that contains part or all of the bison parser skeleton | you may create a larger work that contains part or all of the bison parser skeleton | 64 | 0.93
gfdl-sections-text | gfdl | with no invariant sections no front cover texts and no back cover texts | with no invariant sections no front cover texts and no back cover texts | 68 | 0.96
gfdl-section-copy | gfdl | a copy of the license is included in the section entitled | a copy of the license is included in the section entitled gnu free documentation license | 68 | 0.96
apache-patent | apache-2.0 | patent license to make have made use offer to sell sell import and otherwise transfer the work | hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable .{0,60}? patent license to make have made use offer to sell sell import and otherwise transfer the work | 66 | 0.94
apache-11-product | apache-1.1 | this product includes software developed by the apache software foundation | this product includes software developed by the apache software foundation | 62 | 0.92
mit-0-grant | mit-0 | to permit persons to whom the software is furnished to do so the software is provided as is | to permit persons to whom the software is furnished to do so the software is provided as is | 66 | 0.9
mit-advertising | mit-advertising | display the following acknowledgement this product includes software developed by | display the following acknowledgement this product includes software developed by | 56 | 0.8
mit-x-name | x11 | the name of the x consortium shall not be used in advertising | except as contained in this notice the name of the x consortium shall not be used in advertising | 68 | 0.96
mit-feh | mit | acknowledgment shall be given in the documentation materials and software packages | acknowledgment shall be given in the documentation materials and software packages that this software was used | 60 | 0.85
bsd-regents-text | bsd-4-clause | this product includes software developed by the university of california berkeley | this product includes software developed by the university of california berkeley and its contributors | 68 | 0.96
bsd-consequential | bsd | be liable for any direct indirect incidental special exemplary or consequential damages | be liable for any direct indirect incidental special exemplary or consequential damages | 54 | 0.82
bsd-patent-text | bsd-2-clause-patent | licensable by such copyright holders or contributors | patent claims licensable by such copyright holders or contributors | 62 | 0.9
bsd-nuclear | bsd-3-clause-no-nuclear | not designed licensed or intended for use in the design construction operation or maintenance of any nuclear | not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility | 70 | 0.97
mpl-basis | mpl-1.1 | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations | 64 | 0.92
edl-terms | edl | eclipse distribution license | eclipse distribution license(?: v(?:ersion)? ?1 0)? | 60 | 0.93
cpl-terms | cpl | common public license | common public license(?: version)?(?: 1 0| 0 5)? | 56 | 0.9
eupl-terms | eupl | licensed under the eupl | licensed under the eupl(?: version)?(?: 1 [012])? | 66 | 0.95
cecill-terms | cecill | governed by the cecill | governed by the cecill(?: b| c)? license under french law | 68 | 0.97
artistic-package | artistic | the collection of files distributed by the copyright holder | package (?:refers to|means) the collection of files distributed by the copyright holder | 58 | 0.88
afl | afl | academic free license | academic free license(?: version)?(?: [123] [012])? | 56 | 0.92
zlib-arising | zlib | in no event will the authors be held liable for any damages arising from the use of this software | in no event will the authors be held liable for any damages arising from the use of this software | 62 | 0.9
zlib-permission | zlib | permission is granted to anyone to use this software for any purpose including commercial applications | permission is granted to anyone to use this software for any purpose including commercial applications | 64 | 0.94
bzip2-origin | bzip2 | if you use this software in a product an acknowledgment in the product documentation would be appreciated | if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required | 58 | 0.85
boost-accompanying | boost | see accompanying file license 1 0 txt or copy at | see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt | 70 | 0.98
unlicense-anyone | unlicense | anyone is free to copy modify publish use compile sell or distribute this software | anyone is free to copy modify publish use compile sell or distribute this software | 68 | 0.96
zero-bsd | 0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is | 70 | 0.95
isc-modify | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice | 70 | 0.96
blessing | sqlite-blessing | may you do good and not evil may you find forgiveness for yourself and forgive others | may you do good and not evil may you find forgiveness for yourself and forgive others | 70 | 0.98
sqlite-disclaims | public-domain | the author disclaims copyright to this source code | the author disclaims copyright to this source code | 64 | 0.93
public-domain-placed | public-domain | hereby placed in the public domain | (?:is|are) hereby placed in the public domain | 56 | 0.88
public-domain-dedicate | public-domain | dedicate any and all copyright interest in the software to the public domain | dedicate any and all copyright interest in the software to the public domain | 62 | 0.93
us-government-work | public-domain | not subject to copyright protection and is in the public domain | not subject to copyright protection and is in the public domain | 58 | 0.88
python-cnri | python-cnri | corporation for national research initiatives | corporation for national research initiatives having an office at | 60 | 0.9
unicode-data | unicode | associated documentation files the data files or unicode software | any associated documentation files the data files or unicode software | 66 | 0.95
icu-grant | icu | provided that the above copyright notice s and this permission notice appear in all copies of the software | provided that the above copyright notice s and this permission notice appear in all copies of the software | 64 | 0.92
w3c-notice | w3c | w3c software notice and license | w3c software notice and license | 62 | 0.95
tcl-grant | tcl | provided that existing copyright notices are retained in all copies and that this notice is included verbatim | provided that existing copyright notices are retained in all copies and that this notice is included verbatim in any distributions | 68 | 0.96
lppl-terms | lppl | latex project public license | latex project public license(?: either)?(?: version)?(?: 1 [0-3])? | 60 | 0.95
imagemagick | imagemagick | licensed under the imagemagick license | licensed under the imagemagick license the license | 64 | 0.95
info-zip | info-zip | info zip is defined as the following set of individuals | info zip is defined as the following set of individuals | 64 | 0.95
net-snmp | net-snmp | networks associates technology | networks associates technology inc all rights reserved | 52 | 0.8
cc-by-nd-grant | cc-by-nd | licensed under a creative commons attribution noderivatives | this work is licensed under a creative commons attribution noderivatives [1234] [05](?: international| unported)? license | 72 | 0.98
cc-by-nc-sa-grant | cc-by-nc-sa | licensed under a creative commons attribution noncommercial sharealike | this work is licensed under a creative commons attribution noncommercial sharealike [1234] [05](?: international| unported)? license | 73 | 0.98
cc-by-nc-nd-grant | cc-by-nc-nd | licensed under a creative commons attribution noncommercial noderivatives | this work is licensed under a creative commons attribution noncommercial noderivatives [1234] [05](?: international| unported)? license | 73 | 0.98
cc-open-access | cc-by | open access article distributed under the terms of the creative commons attribution license | this is an open access article distributed under the terms of the creative commons attribution license | 70 | 0.97
cc-unrestricted | cc-by | permits unrestricted use distribution and reproduction in any medium provided the original work is properly cited | permits unrestricted use distribution and reproduction in any medium provided the original work is properly cited | 68 | 0.95
odc-by | odc-by | open data commons attribution license | open data commons attribution license(?: odc by)?(?: v1 0)? | 62 | 0.94
gov-etalab | etalab | licence ouverte | licence ouverte(?: open licence)?(?: version)?(?: [12] 0)? | 56 | 0.9
dl-de | dl-de | datenlizenz deutschland | datenlizenz deutschland(?: namensnennung| zero)?(?: version)? ?2 0 | 60 | 0.95
nasa-nosa | nasa | nasa open source agreement | nasa open source agreement(?: version)?(?: 1 3)? | 60 | 0.94
sun-bcl | bcl | sun microsystems inc binary code license agreement | sun microsystems inc binary code license agreement | 62 | 0.95
sun-rpc | sun-rpc | sun rpc is a product of sun microsystems inc and is provided for unrestricted use | sun rpc is a product of sun microsystems inc and is provided for unrestricted use | 66 | 0.96
commons-clause | commons-clause | the license does not grant to you the right to sell the software | the grant of rights under the license will not include and the license does not grant to you the right to sell the software | 70 | 0.97
intel-acpi | intel | intel grants free of charge to any person the licensee obtaining a copy of the source code | intel grants free of charge to any person the licensee obtaining a copy of the source code | 64 | 0.93
nvidia-proprietary | proprietary | any use reproduction disclosure or distribution of this material and related documentation without an express license agreement | any use reproduction disclosure or distribution of this material and related documentation without an express license agreement | 66 | 0.94
copying-strictly | proprietary | unauthorized copying of this file via any medium is strictly prohibited | unauthorized copying of this file via any medium is strictly prohibited | 66 | 0.95
llama-community | llama | community license agreement copyright meta platforms | llama [234](?: [0-9])? community license agreement copyright meta platforms|licensed under the llama [234](?: [0-9])? community license agreement copyright meta platforms | 68 | 0.95
gemma-terms | gemma | provided under and subject to the gemma terms of use | gemma is provided under and subject to the gemma terms of use | 68 | 0.97
python-beopen | python-beopen | this license agreement is between beopen com | this license agreement is between beopen com having an office at | 64 | 0.95
glide | glide | 3dfx glide source code general public license | 3dfx glide source code general public license | 62 | 0.95
spencer | spencer-94 | permission is granted to anyone to use this software for any purpose on any computer system | permission is granted to anyone to use this software for any purpose on any computer system | 66 | 0.96
libtiff | libtiff | the names of sam leffler and silicon graphics may not be used in any advertising | the names of sam leffler and silicon graphics may not be used in any advertising | 68 | 0.97
sgi-b | sgi-b | sgi free software license b | sgi free software license b(?: version)?(?: 2 0)? | 60 | 0.95
xfree86 | xfree86 | the name of the xfree86 project inc shall not be used in advertising | the name of the xfree86 project inc shall not be used in advertising | 66 | 0.96
trade-secret | proprietary | trade secrets | (?:contains|protected by) trade secrets | 42 | 0.7
""".strip()


def default_rules() -> list[Rule]:
    """The base phrases, each licence by each form of notice, and the clauses; several hundred rules."""
    rules = [Rule(f"base:{label}", label, phrase, phrase, 10, 0.75, True) for phrase, label in BASE.items()]
    for line in LICENSES.splitlines():
        label, keyword, name, tag = (x.strip() for x in re.split(r" \| ", line))
        for k, (form, priority, confidence) in enumerate(NOTICES):
            # a tag line may spell the licence in another way than its name
            word = "spdx license identifier" if "{tag}" in form else keyword
            rules.append(Rule(f"{label}:{keyword}:{k}", label, word, form.format(name=name, tag=tag), priority, confidence))
    for line in CLAUSES.splitlines():
        name, label, keyword, pattern, priority, confidence = (x.strip() for x in re.split(r" \| ", line))
        rules.append(Rule(name, label, keyword, pattern, int(priority), float(confidence)))
    return rules


#: ASCII upper to lower case, other ASCII non-alphanumerics to a space, bytes of other characters as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: str) -> tuple[str, int]:
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} ", len(words)


def resolve(found: list[tuple[int, int, int, int]]) -> list[bool]:
    """Which of the detections (start, end, priority, order) are suppressed.

    In order of priority, then length, then rule order, a detection is kept unless a kept one contains it. A Fenwick
    tree over start ranks holds the furthest end of the kept ones: O(n log n) for any number of detections."""
    starts = sorted({d[0] for d in found})
    tree = [-1] * (len(starts) + 1)
    gone = [False] * len(found)
    for i in sorted(range(len(found)), key=lambda i: (-found[i][2], found[i][0] - found[i][1], found[i][3], found[i][0])):
        start, end = found[i][:2]
        rank = bisect_left(starts, start) + 1
        at, most = rank, -1
        while at:
            most = max(most, tree[at])
            at &= at - 1
        if most >= end:
            gone[i] = True
            continue
        while rank < len(tree):
            tree[rank] = max(tree[rank], end)
            rank += rank & -rank
    return gone


class Scanner:
    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules, by = rules, {}
        # a rule that spans base phrases finds every place, overlapping ones too
        self.compiled = [re.compile(f"(?= ({re.escape(r.pattern) if r.base else r.pattern}) )") for r in rules]
        for i, r in enumerate(rules):
            by.setdefault(r.keyword, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, ids in by.items():
            self.automaton.add_word(word, tuple(ids))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[dict]]:
        folded, n = fold(text)
        hit = {i for _, ids in self.automaton.iter(folded) for i in ids} if n else set()
        found = []
        for i in sorted(hit):
            r = self.rules[i]
            found += [(m.start(1), m.end(1), r.priority, i) for m in self.compiled[i].finditer(folded)]
        gone, word, marks, out = resolve(found), 0, {}, []
        last = 0
        for pos in sorted({p for d in found for p in d[:2]}):
            word += folded.count(" ", last, pos)
            last, marks[pos] = pos, word
        for (start, end, priority, i), suppressed in zip(found, gone):
            r = self.rules[i]
            out.append({"rule": r.name, "label": r.label, "start": marks[start] - 1, "end": marks[end], "priority": priority, "confidence": r.confidence, "base": r.base, "suppressed": suppressed})
        out.sort(key=lambda d: (d["start"], -d["priority"], d["end"], d["rule"]))
        return n, out


DETECTION = "array<struct<rule:string,label:string,start:bigint,end:bigint,priority:int,confidence:double,base:boolean,suppressed:boolean>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(id, n_words, detections) for each row; words count from 0 and ``end`` is past the last word."""
    rules = rules or default_rules()

    def make():
        scanner = Scanner(rules)

        def f(batch: pa.RecordBatch):
            got = [scanner.scan(t or "") for t in batch.column(1).to_pylist()]
            return [batch.column(0), [g[0] for g in got], [g[1] for g in got]]

        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), make, f"`{id_col}` {kind}, n_words bigint, detections {DETECTION}", [id_col, "n_words", "detections"])


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Base places, labels and score of each scanned row, from its detections."""
    base = F.filter("detections", lambda d: d["base"])
    kept = F.filter("detections", lambda d: d["base"] | ~d["suppressed"])
    names = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["start"])
    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(kept).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
