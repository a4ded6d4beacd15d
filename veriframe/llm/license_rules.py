"""Ordered licence signatures. Each licence is one hand-written line; every line yields up to four
rules (exact tag, link, grant sentence, bare title), tried in that order of priority.

Fields: label | SPDX tags, comma-separated | title pattern | link pattern (may be empty) | keywords of the title
A title rule only runs on a text that holds one of its keywords; ``license`` in them stands for ``licence``, too. The
other rules bring their own. Blanks are single: rules run on texts whose runs of blanks were made one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

LICENCES = r"""
mit|MIT|(?:the )?(?:expat|mit)[ -]licen[cs]e|opensource\.org/licenses/mit|mit license,mit-license,expat license,expat-license
mit-0|MIT-0|mit no attribution(?: licen[cs]e)?|opensource\.org/licenses/mit-0|mit no attribution
apache-2.0|Apache-2.0|apache(?: software)? licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)?|apache\.org/licenses/license-2\.0|apache license,apache licence,apache software license
apache-1.1|Apache-1.1|apache(?: software)? licen[cs]e,?(?: version| v\.?)? ?1\.1|apache\.org/licenses/license-1\.1|apache license,apache software license
apache|Apache|apache(?: software)? licen[cs]e|apache\.org/licenses/?(?!lic)|apache license,apache licence,apache software license
agpl-3.0|AGPL-3.0,AGPL-3.0-only,AGPL-3.0-or-later|(?:gnu )?affero general public licen[cs]e(?:,? (?:version|v\.?) ?3(?:\.0)?)?|gnu\.org/licenses/agpl|affero general public
lgpl-2.1|LGPL-2.1,LGPL-2.1-only,LGPL-2.1-or-later|(?:gnu )?lesser general public licen[cs]e,? (?:version|v\.?) ?2\.1|gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1|lesser general public
lgpl-3.0|LGPL-3.0,LGPL-3.0-only,LGPL-3.0-or-later|(?:gnu )?lesser general public licen[cs]e,? (?:version|v\.?) ?3(?:\.0)?|gnu\.org/licenses/lgpl-3\.0|lesser general public
lgpl|LGPL|(?:gnu )?(?:lesser|library) general public licen[cs]e|gnu\.org/licenses/lgpl|lesser general public,library general public
gpl-2.0|GPL-2.0,GPL-2.0-only,GPL-2.0-or-later|(?:gnu )?general public licen[cs]e,? (?:version|v\.?) ?2(?:\.0)?|gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0|general public license,general public licence
gpl-3.0|GPL-3.0,GPL-3.0-only,GPL-3.0-or-later|(?:gnu )?general public licen[cs]e,? (?:version|v\.?) ?3(?:\.0)?|gnu\.org/licenses/gpl-3\.0|general public license,general public licence
gpl|GPL|(?:gnu )?general public licen[cs]e|gnu\.org/licenses/gpl|general public license,general public licence
gfdl-1.3|GFDL-1.3,GFDL-1.3-only,GFDL-1.3-or-later|(?:gnu )?free documentation licen[cs]e(?:,? (?:version|v\.?) ?1\.\d)?|gnu\.org/licenses/fdl|free documentation license
bsd-2-clause|BSD-2-Clause,BSD-2-Clause-FreeBSD|(?:simplified bsd|freebsd|bsd[ -]2[ -]clause|2[ -]clause bsd) licen[cs]e|opensource\.org/licenses/bsd-2-clause|simplified bsd,freebsd license,2-clause,2 clause
bsd-3-clause|BSD-3-Clause,BSD-3-Clause-Clear|(?:new bsd|modified bsd|revised bsd|bsd[ -]3[ -]clause|3[ -]clause bsd) licen[cs]e|opensource\.org/licenses/bsd-3-clause|new bsd,modified bsd,revised bsd,3-clause,3 clause
bsd-4-clause|BSD-4-Clause,BSD-4-Clause-UC|(?:original bsd|old bsd|bsd[ -]4[ -]clause|4[ -]clause bsd) licen[cs]e||original bsd,old bsd,4-clause,4 clause
0bsd|0BSD|(?:zero[ -]clause bsd|bsd zero[ -]clause) licen[cs]e|opensource\.org/licenses/0bsd|zero-clause,zero clause
bsd|BSD|(?:the )?bsd(?:-style)? licen[cs]e|opensource\.org/licenses/bsd-license|bsd license,bsd licence,bsd-style license
isc|ISC|(?:the )?isc licen[cs]e|opensource\.org/licenses/isc|isc license,isc licence
mpl-1.1|MPL-1.1|mozilla public licen[cs]e,?(?: version| v\.?)? ?1\.1|mozilla\.org/mpl/1\.1|mozilla public
mpl-2.0|MPL-2.0,MPL-2.0-no-copyleft-exception|mozilla public licen[cs]e(?:,?(?: version| v\.?)? ?2(?:\.0)?)?|mozilla\.org/(?:en-us/)?mpl/2\.0|mozilla public
epl-1.0|EPL-1.0|eclipse public licen[cs]e,?(?: version| v\.?| -)? ?v?1\.0|eclipse\.org/legal/epl-v10|eclipse public
epl-2.0|EPL-2.0|eclipse public licen[cs]e(?:,?(?: version| v\.?| -)? ?v?2(?:\.0)?)?|eclipse\.org/legal/epl-v?2\.?0|eclipse public
edl-1.0|EDL-1.0|eclipse distribution licen[cs]e|eclipse\.org/org/documents/edl-v10|eclipse distribution
cddl-1.0|CDDL-1.0|common development and distribution licen[cs]e|opensource\.org/licenses/cddl-1\.0|common development and distribution
cddl-1.1|CDDL-1.1|common development and distribution licen[cs]e,?(?: version)? 1\.1||common development and distribution
cpl-1.0|CPL-1.0|common public licen[cs]e(?: version 1\.0)?|opensource\.org/licenses/cpl1\.0|common public license
eupl-1.2|EUPL-1.1,EUPL-1.2|european union public licen[cs]e(?:,? (?:version|v\.?) ?1\.\d)?|joinup\.ec\.europa\.eu/.{0,40}eupl|european union public
artistic-1.0|Artistic-1.0,Artistic-1.0-Perl|artistic licen[cs]e,?(?: version)? 1\.0|opensource\.org/licenses/artistic-license-1\.0|artistic license
artistic-2.0|Artistic-2.0|artistic licen[cs]e(?:,?(?: version)? ?2(?:\.0)?)?|opensource\.org/licenses/artistic-license-2\.0|artistic license
bsl-1.0|BSL-1.0|boost software licen[cs]e(?:(?: -)?,?(?: version)? ?1\.0)?|boost\.org/license_1_0|boost software
busl-1.1|BUSL-1.1|business source licen[cs]e(?: 1\.1)?|mariadb\.com/bsl11|business source license
sspl-1.0|SSPL-1.0|server side public licen[cs]e|mongodb\.com/licensing/server-side-public|server side public
elastic-2.0|Elastic-2.0|elastic licen[cs]e(?: 2\.0)?|elastic\.co/licensing/elastic-license|elastic license
zlib|Zlib|(?:the )?zlib(?:/libpng)? licen[cs]e|opensource\.org/licenses/zlib|zlib license,zlib/libpng
libpng|Libpng,libpng-2.0|(?:png reference library|libpng) licen[cs]e|libpng\.org/pub/png/src/libpng-license|libpng license,png reference library
unlicense|Unlicense|(?:the )?unlicense|unlicense\.org|unlicense
wtfpl|WTFPL|do what the f\S+ you want to public licen[cs]e|wtfpl\.net|you want to public license
cc0-1.0|CC0-1.0|(?:cc0 1\.0 universal|cc0 public domain dedication|creative commons zero)|creativecommons\.org/publicdomain/zero/1\.0|cc0 1.0,cc0 public,creative commons zero
cc-by-nc-nd-4.0|CC-BY-NC-ND-4.0,CC-BY-NC-ND-3.0|cc[ -]by-nc-nd(?: \d\.\d)?|creativecommons\.org/licenses/by-nc-nd|cc by-nc-nd,cc-by-nc-nd
cc-by-nc-sa-4.0|CC-BY-NC-SA-4.0,CC-BY-NC-SA-3.0|cc[ -]by-nc-sa(?: \d\.\d)?|creativecommons\.org/licenses/by-nc-sa|cc by-nc-sa,cc-by-nc-sa
cc-by-nc-4.0|CC-BY-NC-4.0,CC-BY-NC-3.0|cc[ -]by-nc(?: \d\.\d)?|creativecommons\.org/licenses/by-nc/|cc by-nc,cc-by-nc
cc-by-nd-4.0|CC-BY-ND-4.0,CC-BY-ND-3.0|cc[ -]by-nd(?: \d\.\d)?|creativecommons\.org/licenses/by-nd|cc by-nd,cc-by-nd
cc-by-sa-4.0|CC-BY-SA-4.0,CC-BY-SA-3.0|cc[ -]by-sa(?: \d\.\d)?|creativecommons\.org/licenses/by-sa|cc by-sa,cc-by-sa
cc-by-4.0|CC-BY-4.0,CC-BY-3.0|cc[ -]by(?![-\w])(?: \d\.\d)?|creativecommons\.org/licenses/by/|cc by,cc-by
creative-commons||creative commons(?: attribution[\w -]{0,60})?(?: \d\.\d)?(?: international| unported)?||creative commons
odbl-1.0|ODbL-1.0|open database licen[cs]e|opendatacommons\.org/licenses/odbl|open database license
odc-by-1.0|ODC-By-1.0|open data commons attribution licen[cs]e|opendatacommons\.org/licenses/by|open data commons attribution
pddl-1.0|PDDL-1.0|public domain dedication and licen[cs]e|opendatacommons\.org/licenses/pddl|public domain dedication and licen
ofl-1.1|OFL-1.0,OFL-1.1|(?:sil )?open font licen[cs]e(?:,? version 1\.\d)?|scripts\.sil\.org/ofl|open font license
python-2.0|PSF-2.0,Python-2.0|python software foundation licen[cs]e|docs\.python\.org/.{0,12}license|python software foundation license
php-3.01|PHP-3.0,PHP-3.01|php licen[cs]e(?:,? version 3\.01?)?|php\.net/license|php license
ruby|Ruby|(?:the )?ruby licen[cs]e|ruby-lang\.org/.{0,12}license|ruby license
perl||same terms as perl(?: itself)?||same terms as perl
vim|Vim|(?:the )?vim licen[cs]e||vim license
postgresql|PostgreSQL|(?:the )?postgresql licen[cs]e|postgresql\.org/about/licence|postgresql license,postgresql licence
openssl|OpenSSL|openssl licen[cs]e|openssl\.org/source/license|openssl license
curl|curl|curl licen[cs]e|curl\.se/docs/copyright|curl license
ncsa|NCSA|university of illinois/ncsa open source licen[cs]e|opensource\.org/licenses/ncsa|ncsa open source
ms-pl|MS-PL|microsoft public licen[cs]e|opensource\.org/licenses/ms-pl|microsoft public license
ms-rl|MS-RL|microsoft reciprocal licen[cs]e|opensource\.org/licenses/ms-rl|microsoft reciprocal
osl-3.0|OSL-3.0|open software licen[cs]e(?: (?:version|v\.?) ?\d\.\d)?|opensource\.org/licenses/osl-3\.0|open software license
afl-3.0|AFL-2.1,AFL-3.0|academic free licen[cs]e(?: (?:version|v\.?) ?\d\.\d)?|opensource\.org/licenses/afl-3\.0|academic free license
ecl-2.0|ECL-2.0|educational community licen[cs]e|opensource\.org/licenses/ecl-2\.0|educational community license
upl-1.0|UPL-1.0|universal permissive licen[cs]e|opensource\.org/licenses/upl|universal permissive
blueoak-1.0.0|BlueOak-1.0.0|blue oak model licen[cs]e|blueoakcouncil\.org/license|blue oak model
mulanpsl-2.0|MulanPSL-2.0|mulan p(?:ermissive software|sl) licen[cs]e|license\.coscl\.org\.cn/mulanpsl2|mulan p
lppl-1.3c|LPPL-1.3a,LPPL-1.3c|latex project public licen[cs]e|latex-project\.org/lppl|latex project public
ijg|IJG|independent jpeg group licen[cs]e||independent jpeg group
icu|ICU|icu licen[cs]e||icu license
unicode-dfs|Unicode-3.0,Unicode-DFS-2016|unicode licen[cs]e agreement|unicode\.org/license|unicode license
w3c|W3C|w3c software (?:notice and )?licen[cs]e|w3\.org/consortium/legal/.{0,20}software|w3c software
zpl-2.1|ZPL-2.1|zope public licen[cs]e|zope\.org/resources/zpl|zope public
qpl-1.0|QPL-1.0|q public licen[cs]e||q public license
sleepycat|Sleepycat|sleepycat licen[cs]e||sleepycat
json|JSON|(?:the )?json licen[cs]e|json\.org/license|json license
beerware|Beerware|beer-?ware licen[cs]e||beerware,beer-ware
public-domain||(?:released|placed|dedicated|is) (?:in|into|to) the public domain||the public domain
openrail|OpenRAIL|(?:creativeml )?open ?rail(?:-[ms]+)?(?: licen[cs]e)?|huggingface\.co/spaces/.{0,40}license|openrail,open rail
llama|Llama-2|llama \d(?:\.\d)? community licen[cs]e|ai\.meta\.com/llama/license|community license
proprietary||(?:proprietary and confidential|all rights reserved)||proprietary and confidential,all rights reserved
commercial||commercial licen[cs]e agreement||commercial license agreement
eula||end[ -]user licen[cs]e agreement||user license agreement,user licence agreement
copyright||(?:copyright|\(c\)|©) (?:\(c\) )?(?:19|20)\d\d||copyright,(c) 19,(c) 20,© 19,© 20
""".strip()

#: Grant sentences without a title: label | pattern | keywords.
GRANTS = r"""
mit|permission is hereby granted, free of charge, to any person obtaining a copy|permission is hereby granted
isc|permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose|permission to use, copy
bsd|redistribution and use in source and binary forms|redistribution and use in source
bsd-3-clause|neither the name of .{1,80} nor the names of (?:its|their) contributors|nor the names of
bsd-4-clause|all advertising materials mentioning features or use of this software|all advertising materials
zlib|this software is provided 'as-is', without any express or implied warranty|provided 'as-is'
gpl|this program is free software[:;] you can redistribute it|this program is free software
lgpl|this library is free software[:;] you can redistribute it|this library is free software
mpl-2.0|this source code form is subject to the terms of the mozilla public|this source code form
unlicense|this is free and unencumbered software released into the public domain|free and unencumbered software
bsl-1.0|permission is hereby granted, free of charge, to any person or organization|person or organization
apache-2.0|unless required by applicable law or agreed to in writing, software distributed under the license|unless required by applicable law
""".strip()

#: Chance that a rule of a kind is right; also orders the kinds.
WEIGHT = {"tag": 0.98, "link": 0.95, "grant": 0.92, "under": 0.9, "title": 0.75}
_WEAK = {"copyright": 0.3, "proprietary": 0.5, "public-domain": 0.5, "creative-commons": 0.6}


@dataclass(frozen=True)
class Rule:
    priority: int  # smaller is tried and kept first
    kind: str
    label: str
    pattern: str
    keywords: tuple[str, ...]
    weight: float


def _beginning(pattern: str) -> str:
    """The literal text that every match of ``pattern`` begins with."""
    literal = re.match(r"(?:[\w/-]|\\\.)+", pattern)[0]
    if pattern[len(literal) :][:1] in ("?", "*"):
        literal = literal[:-1]
    return literal.replace("\\.", ".")


def rules() -> list[Rule]:
    found: list[tuple[str, str, str, tuple[str, ...]]] = []
    for line in LICENCES.splitlines():
        label, tags, rest = line.split("|", 2)
        title, link, keywords = rest.rsplit("|", 2)  # a title may hold | itself
        words = tuple(dict.fromkeys(w for k in keywords.split(",") for w in (k, k.replace("license", "licence"))))
        if tags:
            either = "|".join(re.escape(x.lower()) for x in sorted(tags.split(","), key=len, reverse=True))
            found.append(("tag", label, rf"spdx-license-identifier:\s*(?:{either})(?![\w.-])", ("spdx-license-identifier",)))
        if link:
            found.append(("link", label, link, (_beginning(link),)))
        found.append(("under", label, rf"(?:licen[cs]ed|released|distributed|available|provided|made available) under (?:the )?(?:terms of )?(?:the )?{title}", words))
        found.append(("title", label, rf"(?<!\w)(?:{title})(?!\w)", words))
    for line in GRANTS.splitlines():
        label, rest = line.split("|", 1)
        pattern, keyword = rest.rsplit("|", 1)
        found.append(("grant", label, pattern, (keyword,)))
    order = list(WEIGHT)
    found.sort(key=lambda x: order.index(x[0]))  # stable: within a kind the order of the lines above
    return [Rule(i, k, label, p, w, WEIGHT[k] * _WEAK.get(label, 1.0)) for i, (k, label, p, w) in enumerate(found)]
