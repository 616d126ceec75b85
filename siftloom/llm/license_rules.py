"""Signature rules for licences, in order: label; keyword; kind; regex.

Every text that the regex matches holds the keyword (both in lower case). Regexes ignore
the case of A-Z. Kinds, from the strongest: notice (a licence's own text), tag (an SPDX
identifier), name (a licence by its name), link (its address), hint (a bare mention).
"""

from __future__ import annotations

PRIORITY = {"base": 6, "notice": 5, "tag": 4, "name": 3, "link": 2, "hint": 1}
WEIGHT = {"base": 0.95, "notice": 1.0, "tag": 0.98, "name": 0.9, "link": 0.8, "hint": 0.4}
#: Phrases whose places are counted (fixed values): phrase, label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

RULES = r"""
mit;permission is hereby granted;notice;permission is hereby granted,? free of charge,? to any person obtaining a copy\s+of this software
mit;without restriction;notice;to deal in the software without restriction,? including without limitation
mit;mit;tag;SPDX-License-Identifier:?\s*MIT\b(?!-)
mit;mit;name;\bMIT[\s-]+licen[cs]ed?\b
mit;mit;name;\blicen[cs]ed? (?:under|by) (?:the )?(?:terms of (?:the )?)?MIT\b
mit;expat;name;\bexpat licen[cs]e\b
mit;opensource.org/licenses/mit;link;https?://(?:www\.)?opensource\.org/licenses/mit(?:-license)?
mit;mit-license.org;link;https?://(?:[a-z]+\.)?mit-license\.org
mit-0;mit-0;tag;\bMIT-0\b
mit-0;no attribution;name;\bMIT no attribution\b
x11;x11;name;\bX11 licen[cs]e\b
x11;x11;tag;SPDX-License-Identifier:?\s*X11\b
apache-2.0;licensed under the apache license;notice;licensed under the apache license,?\s+version 2\.0 \(the "?license"?\)
apache-2.0;unless required by applicable law;notice;unless required by applicable law or agreed to in writing,? software\s+distributed under the license
apache-2.0;apache;tag;SPDX-License-Identifier:?\s*Apache-2\.0\b
apache-2.0;apache;name;\bApache(?: software)? Licen[cs]e,?\s*(?:\(?v(?:ersion)?\.?\s*)?2(?:\.0)?\b
apache-2.0;apache;name;\bApache[\s-]+2(?:\.0)?\b
apache-2.0;apache.org/licenses/license-2.0;link;https?://(?:www\.)?apache\.org/licenses/LICENSE-2\.0
apache-1.1;apache;tag;SPDX-License-Identifier:?\s*Apache-1\.1\b
apache-1.1;apache;name;\bApache(?: software)? Licen[cs]e,?\s*(?:v(?:ersion)?\.?\s*)?1\.1\b
apache-1.0;apache;tag;SPDX-License-Identifier:?\s*Apache-1\.0\b
apache-1.0;apache;name;\bApache(?: software)? Licen[cs]e,?\s*(?:v(?:ersion)?\.?\s*)?1\.0\b
apache;apache;hint;\bApache[\s-]+licen[cs]ed\b
gpl-3.0;either version 3 of the license;notice;gnu general public license as published by\s+the free software foundation,? either version 3 of the license
gpl-2.0;either version 2 of the license;notice;gnu general public license as published by\s+the free software foundation,? either version 2 of the license
gpl-3.0;gpl;tag;SPDX-License-Identifier:?\s*GPL-3\.0(?:-only|-or-later|\+)?
gpl-2.0;gpl;tag;SPDX-License-Identifier:?\s*GPL-2\.0(?:-only|-or-later|\+)?
gpl-1.0;gpl;tag;SPDX-License-Identifier:?\s*GPL-1\.0(?:-only|-or-later|\+)?
gpl-3.0;general public license;name;\bGNU General Public License,?\s*(?:\(GPL\),?\s*)?(?:v(?:ersion)?\.?\s*)3(?:\.0)?\b
gpl-2.0;general public license;name;\bGNU General Public License,?\s*(?:\(GPL\),?\s*)?(?:v(?:ersion)?\.?\s*)2(?:\.0)?\b
gpl-1.0;general public license;name;\bGNU General Public License,?\s*(?:\(GPL\),?\s*)?(?:v(?:ersion)?\.?\s*)1(?:\.0)?\b
gpl-3.0;gpl;name;\b(?:GNU )?GPL(?:[\s-]*v|\s*version\s*|-)\s*3(?:\.0)?\b\+?
gpl-2.0;gpl;name;\b(?:GNU )?GPL(?:[\s-]*v|\s*version\s*|-)\s*2(?:\.0)?\b\+?
gpl-3.0;gnu.org/licenses/gpl-3.0;link;https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0
gpl-2.0;gnu.org/licenses/;link;https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-2.0;classpath exception;name;\bGPL\S* with (?:the )?classpath exception\b
gpl;gpl;hint;\bGNU GPL\b
lgpl-3.0;lgpl;tag;SPDX-License-Identifier:?\s*LGPL-3\.0(?:-only|-or-later|\+)?
lgpl-2.1;lgpl;tag;SPDX-License-Identifier:?\s*LGPL-2\.1(?:-only|-or-later|\+)?
lgpl-2.0;lgpl;tag;SPDX-License-Identifier:?\s*LGPL-2\.0(?:-only|-or-later|\+)?
lgpl-3.0;lesser general public license;name;\bGNU Lesser General Public License,?\s*(?:\(LGPL\),?\s*)?(?:v(?:ersion)?\.?\s*)3(?:\.0)?\b
lgpl-2.1;lesser general public license;name;\bGNU Lesser General Public License,?\s*(?:\(LGPL\),?\s*)?(?:v(?:ersion)?\.?\s*)2\.1\b
lgpl-2.0;library general public license;name;\bGNU Library General Public License\b
lgpl-3.0;lgpl;name;\bLGPL(?:[\s-]*v|\s*version\s*|-)\s*3(?:\.0)?\b\+?
lgpl-2.1;lgpl;name;\bLGPL(?:[\s-]*v|\s*version\s*|-)\s*2\.1\b\+?
lgpl-3.0;gnu.org/licenses/lgpl-3.0;link;https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0
lgpl-2.1;gnu.org/licenses/;link;https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl;lesser general public license;hint;\bLesser General Public License\b
lgpl;lgpl;hint;\bLGPL\b
agpl-3.0;affero general public license;notice;gnu affero general public license as published\s+by the free software foundation,? either version 3
agpl-3.0;agpl;tag;SPDX-License-Identifier:?\s*AGPL-3\.0(?:-only|-or-later|\+)?
agpl-3.0;affero general public license;name;\bGNU Affero General Public License(?:,?\s*(?:v(?:ersion)?\.?\s*)3(?:\.0)?)?
agpl-3.0;agpl;name;\bAGPL(?:[\s-]*v|\s*version\s*|-)\s*3(?:\.0)?\b\+?
agpl-3.0;gnu.org/licenses/agpl;link;https?://(?:www\.)?gnu\.org/licenses/agpl(?:-3\.0)?
gfdl-1.3;free documentation license;notice;under the terms of the gnu free documentation license,?\s+version 1\.3
gfdl-1.3;gfdl;tag;SPDX-License-Identifier:?\s*GFDL-1\.3(?:-only|-or-later)?
gfdl-1.2;gfdl;tag;SPDX-License-Identifier:?\s*GFDL-1\.2(?:-only|-or-later)?
gfdl;free documentation license;name;\bGNU Free Documentation License\b
gfdl;gnu.org/licenses/fdl;link;https?://(?:www\.)?gnu\.org/licenses/fdl
bsd-3-clause;neither the name of;notice;neither the name of .{1,120}? nor the names of its\s+contributors may be used to endorse
bsd-2-clause;redistributions in binary form;notice;redistributions in binary form must reproduce the above copyright\s+notice
bsd;redistribution and use in source;notice;redistribution and use in source and binary forms,? with or without\s+modification,? are permitted
bsd-4-clause;all advertising materials;notice;all advertising materials mentioning features or use of this software
bsd-3-clause;bsd;tag;SPDX-License-Identifier:?\s*BSD-3-Clause\b
bsd-2-clause;bsd;tag;SPDX-License-Identifier:?\s*BSD-2-Clause\b
bsd-4-clause;bsd;tag;SPDX-License-Identifier:?\s*BSD-4-Clause\b
0bsd;0bsd;tag;\b0BSD\b
0bsd;zero-clause bsd;name;\bzero-clause BSD\b
bsd-3-clause;bsd;name;\b(?:new|modified|revised|3-clause|three-clause) BSD(?: licen[cs]e)?\b
bsd-3-clause;bsd;name;\bBSD[\s-]3[\s-]clause\b
bsd-2-clause;bsd;name;\b(?:simplified|FreeBSD|2-clause|two-clause) BSD(?: licen[cs]e)?\b
bsd-2-clause;bsd;name;\bBSD[\s-]2[\s-]clause\b
bsd-4-clause;bsd;name;\b(?:original|4-clause|four-clause) BSD(?: licen[cs]e)?\b
bsd;opensource.org/licenses/bsd;link;https?://(?:www\.)?opensource\.org/licenses/BSD-[23]-Clause
bsd;bsd;hint;\bBSD[\s-]+licen[cs]ed?\b
isc;permission to use, copy, modify;notice;permission to use, copy, modify,? and(?:/or)? distribute this software for any\s+purpose with or without fee
isc;isc;tag;SPDX-License-Identifier:?\s*ISC\b
isc;isc;name;\bISC licen[cs]e\b
isc;opensource.org/licenses/isc;link;https?://(?:www\.)?opensource\.org/licenses/ISC
mpl-2.0;mozilla public;notice;this source code form is subject to the terms of the mozilla public\s+license,? v\. 2\.0
mpl-2.0;mpl;tag;SPDX-License-Identifier:?\s*MPL-2\.0\b
mpl-1.1;mpl;tag;SPDX-License-Identifier:?\s*MPL-1\.1\b
mpl-2.0;mozilla public license;name;\bMozilla Public License,?\s*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?\b
mpl-1.1;mozilla public license;name;\bMozilla Public License,?\s*(?:v(?:ersion)?\.?\s*)?1\.1\b
mpl-2.0;mpl;name;\bMPL(?:[\s-]*v|\s*version\s*|-|\s)\s*2(?:\.0)?\b
mpl-2.0;mozilla.org/mpl/2.0;link;https?://(?:www\.)?mozilla\.org/MPL/2\.0
mpl;mozilla public license;hint;\bMozilla Public License\b
epl-2.0;epl;tag;SPDX-License-Identifier:?\s*EPL-2\.0\b
epl-1.0;epl;tag;SPDX-License-Identifier:?\s*EPL-1\.0\b
epl-2.0;eclipse public license;name;\bEclipse Public License,?\s*(?:-?\s*v(?:ersion)?\.?\s*)?2(?:\.0)?\b
epl-1.0;eclipse public license;name;\bEclipse Public License,?\s*(?:-?\s*v(?:ersion)?\.?\s*)?1(?:\.0)?\b
epl-2.0;eclipse.org/legal/epl-2.0;link;https?://(?:www\.)?eclipse\.org/legal/epl-2\.0
epl-1.0;eclipse.org/legal/epl-v10;link;https?://(?:www\.)?eclipse\.org/legal/epl-v10
epl;eclipse public license;hint;\bEclipse Public License\b
edl-1.0;eclipse distribution license;name;\bEclipse Distribution License\b
cddl-1.1;cddl;tag;SPDX-License-Identifier:?\s*CDDL-1\.1\b
cddl-1.0;cddl;tag;SPDX-License-Identifier:?\s*CDDL-1\.0\b
cddl;common development and distribution license;name;\bCommon Development and Distribution License\b
cddl;cddl;hint;\bCDDL\b
cpl-1.0;common public license;name;\bCommon Public License\b
cpl-1.0;cpl-1.0;tag;SPDX-License-Identifier:?\s*CPL-1\.0\b
cpal-1.0;common public attribution license;name;\bCommon Public Attribution License\b
eupl-1.2;eupl;tag;SPDX-License-Identifier:?\s*EUPL-1\.2\b
eupl-1.1;eupl;tag;SPDX-License-Identifier:?\s*EUPL-1\.1\b
eupl;european union public licen;name;\bEuropean Union Public Licen[cs]e\b
eupl;eupl;hint;\bEUPL\b
cc-by-nc-nd-4.0;nc-nd;name;\bCC[\s-]BY-NC-ND(?:[\s-]4\.0)?
cc-by-nc-sa-4.0;nc-sa;name;\bCC[\s-]BY-NC-SA(?:[\s-]4\.0)?
cc-by-nc-4.0;by-nc;name;\bCC[\s-]BY-NC[\s-]4\.0
cc-by-nc-3.0;by-nc;name;\bCC[\s-]BY-NC[\s-]3\.0
cc-by-nc;by-nc;name;\bCC[\s-]BY-NC\b
cc-by-nd-4.0;by-nd;name;\bCC[\s-]BY-ND(?:[\s-]4\.0)?
cc-by-sa-4.0;by-sa;name;\bCC[\s-]BY-SA[\s-]4\.0
cc-by-sa-3.0;by-sa;name;\bCC[\s-]BY-SA[\s-]3\.0
cc-by-sa-2.5;by-sa;name;\bCC[\s-]BY-SA[\s-]2\.5
cc-by-sa;by-sa;name;\bCC[\s-]BY-SA\b
cc-by-4.0;cc;name;\bCC[\s-]BY[\s-]4\.0
cc-by-3.0;cc;name;\bCC[\s-]BY[\s-]3\.0
cc-by-2.0;cc;name;\bCC[\s-]BY[\s-]2\.0
cc0-1.0;cc0;name;\bCC0(?:[\s-]1\.0)?(?: universal)?
cc0-1.0;cc0;tag;SPDX-License-Identifier:?\s*CC0-1\.0\b
cc-by-nc-nd;creative commons;name;\bCreative Commons Attribution[\s-]+Non-?commercial[\s-]+No-?deriv(?:ative)?s?(?:\s+\d\.\d)?
cc-by-nc-sa;creative commons;name;\bCreative Commons Attribution[\s-]+Non-?commercial[\s-]+Share-?alike(?:\s+\d\.\d)?
cc-by-nc;creative commons;name;\bCreative Commons Attribution[\s-]+Non-?commercial(?:\s+\d\.\d)?
cc-by-nd;creative commons;name;\bCreative Commons Attribution[\s-]+No-?deriv(?:ative)?s?(?:\s+\d\.\d)?
cc-by-sa;creative commons;name;\bCreative Commons Attribution[\s-]+Share-?alike(?:\s+\d\.\d)?
cc-by;creative commons;name;\bCreative Commons Attribution(?:\s+\d\.\d)?\b
cc0-1.0;creative commons zero;name;\bCreative Commons Zero\b
cc-by-nc-nd;creativecommons.org/licenses/by-nc-nd;link;https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/\d\.\d
cc-by-nc-sa;creativecommons.org/licenses/by-nc-sa;link;https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/\d\.\d
cc-by-nc;creativecommons.org/licenses/by-nc/;link;https?://(?:www\.)?creativecommons\.org/licenses/by-nc/\d\.\d
cc-by-nd;creativecommons.org/licenses/by-nd;link;https?://(?:www\.)?creativecommons\.org/licenses/by-nd/\d\.\d
cc-by-sa;creativecommons.org/licenses/by-sa;link;https?://(?:www\.)?creativecommons\.org/licenses/by-sa/\d\.\d
cc-by;creativecommons.org/licenses/by/;link;https?://(?:www\.)?creativecommons\.org/licenses/by/\d\.\d
cc0-1.0;creativecommons.org/publicdomain/zero;link;https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0
public-domain;creativecommons.org/publicdomain/mark;link;https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0
creative-commons;creative commons;hint;\bCreative Commons licen[cs]e\b
unlicense;released into the public domain;notice;free and unencumbered software released into the public domain
unlicense;unlicense;tag;SPDX-License-Identifier:?\s*Unlicense\b
unlicense;unlicense;name;\bthe unlicense\b
unlicense;unlicense.org;link;https?://(?:www\.)?unlicense\.org
public-domain;public domain;name;\b(?:dedicated|placed|released|is) (?:in|in ?to|to) the public domain\b
public-domain;public domain;hint;\bpublic domain\b
wtfpl;do what the fuck;notice;do what the fuck you want to public license
wtfpl;wtfpl;tag;SPDX-License-Identifier:?\s*WTFPL\b
wtfpl;wtfpl;name;\bWTFPL\b
zlib;altered source versions;notice;altered source versions must be plainly marked as such
zlib;zlib;tag;SPDX-License-Identifier:?\s*Zlib\b
zlib;zlib;name;\bzlib(?:/libpng)? licen[cs]e\b
libpng;libpng;name;\blibpng licen[cs]e\b
bsl-1.0;boost software license;notice;distributed under the boost software license,?\s+version 1\.0
bsl-1.0;bsl-1.0;tag;SPDX-License-Identifier:?\s*BSL-1\.0\b
bsl-1.0;boost software license;name;\bBoost Software License\b
bsl-1.0;boost.org/license_1_0;link;https?://(?:www\.)?boost\.org/LICENSE_1_0\.txt
busl-1.1;busl;tag;\bBUSL-1\.1\b
busl-1.1;business source license;name;\bBusiness Source License(?:\s*1\.1)?
sspl-1.0;sspl;tag;SPDX-License-Identifier:?\s*SSPL-1\.0\b
sspl-1.0;server side public license;name;\bServer Side Public License\b
elastic-2.0;elastic license;name;\bElastic License(?:,?\s*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?)?
elastic-2.0;elastic-2.0;tag;SPDX-License-Identifier:?\s*Elastic-2\.0\b
commons-clause;commons clause;name;\bCommons Clause\b
polyform-nc;polyform;name;\bPolyForm Noncommercial\b
polyform-sb;polyform;name;\bPolyForm Small Business\b
prosperity;prosperity public license;name;\bProsperity Public License\b
parity;parity public license;name;\bParity Public License\b
artistic-2.0;artistic;tag;SPDX-License-Identifier:?\s*Artistic-2\.0\b
artistic-1.0;artistic;tag;SPDX-License-Identifier:?\s*Artistic-1\.0(?:-Perl)?\b
artistic-2.0;artistic;name;\bArtistic License,?\s*(?:v(?:ersion)?\.?\s*)?2(?:\.0)?\b
artistic;artistic;name;\b(?:Perl )?Artistic License\b
perl;perl itself;notice;under the same terms as perl itself
python-2.0;python software foundation license;name;\bPython Software Foundation License\b
python-2.0;python-2.0;tag;SPDX-License-Identifier:?\s*Python-2\.0\b
python-2.0;psf-2.0;tag;SPDX-License-Identifier:?\s*PSF-2\.0\b
python-2.0;psf;name;\bPSF licen[cs]e\b
php-3.01;php license;name;\bPHP License,?\s*(?:v(?:ersion)?\.?\s*)?3\.01
php-3.01;php.net/license;link;https?://(?:www\.)?php\.net/license/3_01
ruby;ruby licen;name;\bRuby licen[cs]e\b
ruby;ruby's licen;name;\bunder Ruby's licen[cs]e\b
postgresql;postgresql;name;\bPostgreSQL licen[cs]e\b
postgresql;postgresql;tag;SPDX-License-Identifier:?\s*PostgreSQL\b
openssl;openssl;name;\bOpenSSL licen[cs]e\b
openssl;openssl project;notice;this product includes software developed by the openssl project
ofl-1.1;open font license;notice;this font software is licensed under the sil open font license
ofl-1.1;ofl-1.1;tag;SPDX-License-Identifier:?\s*OFL-1\.1\b
ofl-1.1;open font license;name;\bSIL Open Font License\b
ofl-1.1;scripts.sil.org/ofl;link;https?://scripts\.sil\.org/OFL
ubuntu-font;ubuntu font licen;name;\bUbuntu Font Licen[cs]e\b
ncsa;ncsa;name;\b(?:University of Illinois/)?NCSA open source licen[cs]e\b
ncsa;ncsa;tag;SPDX-License-Identifier:?\s*NCSA\b
ms-pl;ms-pl;tag;\bMS-PL\b
ms-pl;microsoft public license;name;\bMicrosoft Public License\b
ms-rl;microsoft reciprocal license;name;\bMicrosoft Reciprocal License\b
osl-3.0;open software license;name;\bOpen Software License,?\s*(?:v(?:ersion)?\.?\s*)?3(?:\.0)?
osl-3.0;osl-3.0;tag;SPDX-License-Identifier:?\s*OSL-3\.0\b
afl-3.0;academic free license;name;\bAcademic Free License\b
afl-3.0;afl-3.0;tag;SPDX-License-Identifier:?\s*AFL-3\.0\b
upl-1.0;universal permissive license;name;\bUniversal Permissive License\b
upl-1.0;upl-1.0;tag;SPDX-License-Identifier:?\s*UPL-1\.0\b
ecl-2.0;educational community license;name;\bEducational Community License\b
ecl-2.0;ecl-2.0;tag;SPDX-License-Identifier:?\s*ECL-2\.0\b
mulanpsl-2.0;mulan;name;\bMulan (?:PSL|Permissive Software License)\b
cecill-2.1;cecill;name;\bCeCILL(?:-[BC])?\b
odbl-1.0;open database license;name;\bOpen Database License\b
odbl-1.0;odbl;tag;\bODbL\b
pddl-1.0;pddl;tag;\bPDDL\b
odc-by-1.0;open data commons;name;\bOpen Data Commons Attribution License\b
cdla-permissive;cdla;tag;\bCDLA-Permissive-[12]\.0\b
cdla-sharing;cdla;tag;\bCDLA-Sharing-1\.0\b
ogl-uk-3.0;open government licen;name;\bOpen Government Licen[cs]e\b
etalab-2.0;licence ouverte;name;\blicence ouverte\b
etalab-2.0;etalab;name;\betalab\b
nasa-1.3;nasa open source agreement;name;\bNASA Open Source Agreement\b
apsl-2.0;apple public source license;name;\bApple Public Source License\b
ipl-1.0;ibm public license;name;\bIBM Public License\b
lppl-1.3c;latex project public license;name;\bLaTeX Project Public License\b
lppl-1.3c;lppl;tag;\bLPPL\b
npl-1.1;netscape public license;name;\bNetscape Public License\b
qpl-1.0;q public license;name;\bQ Public License\b
spl-1.0;sun public license;name;\bSun Public License\b
sleepycat;sleepycat;name;\bSleepycat licen[cs]e\b
vim;vim licen;name;\bVim licen[cs]e\b
w3c;w3c software;name;\bW3C Software (?:Notice|and Document)\b
zpl-2.1;zope public license;name;\bZope Public License\b
ncgl;non-commercial government;name;\bNon-Commercial Government Licen[cs]e\b
unicode-dfs;unicode;name;\bUnicode(?:,? Inc\.?)? license agreement\b
hpnd;historical permission notice;name;\bHistorical Permission Notice and Disclaimer\b
beerware;beer-ware;name;\bTHE BEER-WARE LICENSE\b
json;shall be used for good;notice;the software shall be used for good,? not evil
curl;curl licen;name;\bcurl licen[cs]e\b
openrail;openrail;name;\b(?:CreativeML |BigScience |BigCode )?OpenRAIL(?:-[MS+]+)?\b
openrail;open rail;name;\b(?:CreativeML |BigScience |BigCode )?Open RAIL(?:-[MS+]+)?\b
llama;community license;name;\bLlama \d(?:\.\d)? Community License\b
gemma;gemma terms;name;\bGemma Terms of Use\b
fair;fair licen;name;\bFair Licen[cs]e\b
blueoak-1.0.0;blue oak model;name;\bBlue Oak Model License\b
hippocratic;hippocratic license;name;\bHippocratic License\b
anti-996;996 license;name;\bAnti-?996 License\b
proprietary;all rights reserved;notice;\ball rights reserved\b
proprietary;confidential;notice;\bproprietary and confidential\b
proprietary;proprietary;name;\bproprietary licen[cs]e\b
proprietary;unauthorized;notice;unauthorized (?:copying|use|distribution|reproduction)[^.]{0,80} is (?:strictly )?prohibited
eula;user licen;name;\bend[\s-]user licen[cs]e agreement\b
eula;eula;hint;\bEULA\b
commercial;commercial licen;name;\b(?:under a )?commercial licen[cs]e\b
royalty-free;royalty;name;\broyalty[\s-]free licen[cs]e\b
freeware;freeware;hint;\bfreeware\b
shareware;shareware;hint;\bshareware\b
warranty-disclaimer;without warranty of any kind;notice;provided "?as is"?,? without warranty of any kind
warranty-disclaimer;without any warranty;notice;without any warranty;? without even the implied warranty
copyright;copyright;hint;\bcopyright (?:\(c\)|©)?\s*(?:19|20)\d\d\b
spdx;spdx-license-identifier;hint;SPDX-License-Identifier:?\s*\S+
"""


def rules() -> list[tuple[int, str, str, str, str]]:
    """(order, label, keyword, kind, regex) of all rules, the base phrases first.

    A base phrase's words stand consecutively, with anything but letters and digits between.
    """
    word, gap = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    base = [(label, phrase.split()[-1], "base", f"(?<!{word}){gap.join(phrase.split())}(?!{word})") for phrase, label in BASE]
    more = [tuple(line.split(";", 3)) for line in RULES.strip().splitlines()]
    return [(k, label, keyword, kind, f"(?i){regex}") for k, (label, keyword, kind, regex) in enumerate([*base, *more])]


#: Parts that many keywords share.
SHARED_STEMS = ("licen", "gpl", "spdx", "public", "creative", "copyright", "software", "apache", "gnu", "epl", "mpl", "open", "restrict", "distribut", "permission", "commercial", "by-", "nc-", "-1.0", "-2.0", "-3.0")


def stems() -> list[str]:
    """Few texts, at least one of which is in every keyword."""
    rest = {k for _, _, k, _, _ in rules() if not any(s in k for s in SHARED_STEMS)}
    return [*SHARED_STEMS, *sorted(k for k in rest if not any(o != k and o in k for o in rest))]


STEMS = stems()
