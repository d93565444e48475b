"""Signature rules of the licence scan, written by hand: label, and a regular expression over lower-case words joined by single spaces.

A rule's match begins and ends with a word. The sections go from the most to the least telling; where detections overlap, the earlier section wins.
"""

from __future__ import annotations

#: SPDX identifiers, with or without their tag (https://spdx.org/licenses).
IDENTIFIERS = r"""
0bsd | (?:spdx license identifier )?0bsd
afl-1.1 | (?:spdx license identifier )?afl 1 1
afl-2.0 | (?:spdx license identifier )?afl 2 0
afl-2.1 | (?:spdx license identifier )?afl 2 1
afl-3.0 | (?:spdx license identifier )?afl 3 0
agpl-1.0 | (?:spdx license identifier )?agpl 1 0(?: only| or later)?
agpl-3.0 | (?:spdx license identifier )?agpl 3 0(?: only| or later)?
apache-1.0 | (?:spdx license identifier )?apache 1 0
apache-1.1 | (?:spdx license identifier )?apache 1 1
apache-2.0 | (?:spdx license identifier )?apache 2 0
apsl-2.0 | (?:spdx license identifier )?apsl 2 0
artistic-1.0 | (?:spdx license identifier )?artistic 1 0(?: perl)?
artistic-2.0 | (?:spdx license identifier )?artistic 2 0
blueoak-1.0.0 | (?:spdx license identifier )?blueoak 1 0 0
bsd-1-clause | (?:spdx license identifier )?bsd 1 clause
bsd-2-clause | (?:spdx license identifier )?bsd 2 clause(?: patent| views)?
bsd-3-clause | (?:spdx license identifier )?bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4-clause | (?:spdx license identifier )?bsd 4 clause(?: uc)?
bsl-1.0 | (?:spdx license identifier )?bsl 1 0
busl-1.1 | (?:spdx license identifier )?busl 1 1
bzip2 | spdx license identifier bzip2 1 0 6
cc0-1.0 | (?:spdx license identifier )?cc0 1 0
cc-by-1.0 | (?:spdx license identifier )?cc by 1 0
cc-by-2.0 | (?:spdx license identifier )?cc by 2 0
cc-by-2.5 | (?:spdx license identifier )?cc by 2 5
cc-by-3.0 | (?:spdx license identifier )?cc by 3 0
cc-by-4.0 | (?:spdx license identifier )?cc by 4 0
cc-by-sa-2.0 | (?:spdx license identifier )?cc by sa 2 0
cc-by-sa-2.5 | (?:spdx license identifier )?cc by sa 2 5
cc-by-sa-3.0 | (?:spdx license identifier )?cc by sa 3 0
cc-by-sa-4.0 | (?:spdx license identifier )?cc by sa 4 0
cc-by-nc-2.0 | (?:spdx license identifier )?cc by nc 2 0
cc-by-nc-3.0 | (?:spdx license identifier )?cc by nc 3 0
cc-by-nc-4.0 | (?:spdx license identifier )?cc by nc 4 0
cc-by-nd-2.0 | (?:spdx license identifier )?cc by nd 2 0
cc-by-nd-3.0 | (?:spdx license identifier )?cc by nd 3 0
cc-by-nd-4.0 | (?:spdx license identifier )?cc by nd 4 0
cc-by-nc-sa-3.0 | (?:spdx license identifier )?cc by nc sa 3 0
cc-by-nc-sa-4.0 | (?:spdx license identifier )?cc by nc sa 4 0
cc-by-nc-nd-3.0 | (?:spdx license identifier )?cc by nc nd 3 0
cc-by-nc-nd-4.0 | (?:spdx license identifier )?cc by nc nd 4 0
cddl-1.0 | (?:spdx license identifier )?cddl 1 0
cddl-1.1 | (?:spdx license identifier )?cddl 1 1
cecill-2.1 | (?:spdx license identifier )?cecill 2 1
cecill-b | (?:spdx license identifier )?cecill b
cecill-c | (?:spdx license identifier )?cecill c
cpal-1.0 | (?:spdx license identifier )?cpal 1 0
cpl-1.0 | (?:spdx license identifier )?cpl 1 0
curl | spdx license identifier curl
ecl-2.0 | (?:spdx license identifier )?ecl 2 0
efl-2.0 | (?:spdx license identifier )?efl 2 0
elastic-2.0 | (?:spdx license identifier )?elastic 2 0
epl-1.0 | (?:spdx license identifier )?epl 1 0
epl-2.0 | (?:spdx license identifier )?epl 2 0
eupl-1.1 | (?:spdx license identifier )?eupl 1 1
eupl-1.2 | (?:spdx license identifier )?eupl 1 2
gfdl-1.1 | (?:spdx license identifier )?gfdl 1 1(?: only| or later)?
gfdl-1.2 | (?:spdx license identifier )?gfdl 1 2(?: only| or later)?
gfdl-1.3 | (?:spdx license identifier )?gfdl 1 3(?: only| or later)?
gpl-1.0 | (?:spdx license identifier )?gpl 1 0(?: only| or later)?
gpl-2.0 | (?:spdx license identifier )?gpl 2 0(?: only| or later)?
gpl-3.0 | (?:spdx license identifier )?gpl 3 0(?: only| or later)?
hpnd | spdx license identifier hpnd
ibm-ipl-1.0 | (?:spdx license identifier )?ipl 1 0
ijg | spdx license identifier ijg
isc | spdx license identifier isc
lgpl-2.0 | (?:spdx license identifier )?lgpl 2 0(?: only| or later)?
lgpl-2.1 | (?:spdx license identifier )?lgpl 2 1(?: only| or later)?
lgpl-3.0 | (?:spdx license identifier )?lgpl 3 0(?: only| or later)?
libpng-2.0 | (?:spdx license identifier )?libpng 2 0
lppl-1.3c | (?:spdx license identifier )?lppl 1 3c
mit | spdx license identifier mit
mit-0 | spdx license identifier mit 0
mpl-1.0 | (?:spdx license identifier )?mpl 1 0
mpl-1.1 | (?:spdx license identifier )?mpl 1 1
mpl-2.0 | (?:spdx license identifier )?mpl 2 0(?: no copyleft exception)?
ms-pl | spdx license identifier ms pl
ms-rl | spdx license identifier ms rl
mulan-psl-2.0 | (?:spdx license identifier )?mulanpsl 2 0
ncsa | spdx license identifier ncsa
odbl-1.0 | (?:spdx license identifier )?odbl 1 0
odc-by-1.0 | (?:spdx license identifier )?odc by 1 0
ofl-1.1 | (?:spdx license identifier )?ofl 1 1(?: no rfn| rfn)?
openssl | spdx license identifier openssl
osl-2.1 | (?:spdx license identifier )?osl 2 1
osl-3.0 | (?:spdx license identifier )?osl 3 0
pddl-1.0 | (?:spdx license identifier )?pddl 1 0
php-3.01 | (?:spdx license identifier )?php 3 01
postgresql | spdx license identifier postgresql
psf-2.0 | (?:spdx license identifier )?psf 2 0
psf-2.0 | (?:spdx license identifier )?python 2 0
ruby | spdx license identifier ruby
sspl-1.0 | (?:spdx license identifier )?sspl 1 0
unicode-dfs-2016 | (?:spdx license identifier )?unicode dfs 2016
unlicense | spdx license identifier unlicense
upl-1.0 | (?:spdx license identifier )?upl 1 0
vim | spdx license identifier vim
w3c | spdx license identifier w3c
wtfpl | spdx license identifier wtfpl
x11 | spdx license identifier x11
zlib | spdx license identifier zlib
zpl-2.1 | (?:spdx license identifier )?zpl 2 1
"""

#: Sentences of the licences themselves.
BODIES = r"""
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11 | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
bsd | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | neither the names? of .{1,160}? nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) as is and any express or implied warranties
apache-2.0 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0 | grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide
apache-2.0 | grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you
apache-1.1 | this product includes software developed by the apache software foundation
gpl-2.0 | gnu general public license as published by the free software foundation version 2
gpl-3.0 | gnu general public license as published by the free software foundation version 3
gpl-2.0 | gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
gpl-3.0 | gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | this program is distributed in the hope that it will be useful but without any warranty
gpl | you should have received a copy of the gnu general public license along with this program
gpl-2.0 | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | the gnu general public license is a free copyleft license for software and other kinds of works
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)
lgpl-2.1 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version
lgpl-3.0 | gnu lesser general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
lgpl-2.0 | gnu library general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
lgpl-3.0 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
agpl-3.0 | gnu affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
agpl | you should have received a copy of the gnu affero general public license along with this program
agpl-3.0 | the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? ?2 0
epl | the accompanying program is provided under the terms of this eclipse public license
cpl-1.0 | the accompanying program is provided under the terms of this common public license
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution license
cddl | you can obtain a copy of the license at (?:usr src opensolaris license|https? www opensolaris org os licensing)
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2.0 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic-1.0 | you can redistribute it and or modify it under the same terms as perl itself
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | the png reference library is supplied as is
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0 | distributed under the boost software license version 1 0
unlicense | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
wtfpl | you just do what the \S+ you want to
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
cc0-1.0 | to the extent possible under law .{1,160}? has waived all copyright and related or neighboring rights
cc0-1.0 | the person who associated a work with this deed has dedicated the work to the public domain
cc | this work is licensed under (?:a|the) creative commons
ofl-1.1 | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces
python | this license agreement is between the python software foundation psf and the individual or organization
php | this product includes php software freely available from
openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | this product includes cryptographic software written by eric young
ijg | this software is based in part on the work of the independent jpeg group
ncsa | developed by .{1,120}? permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
ms-pl | this license governs use of the accompanying software if you use the software you accept this license
vim | you can use and copy vim as much as you like but you are encouraged to make a donation
curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
upl-1.0 | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service
sspl-1.0 | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
commons-clause | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer in return
json | the software shall be used for good not evil
openldap | redistribution and use of this software and associated documentation software with or without modification are permitted provided that the following conditions are met
unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions
proprietary | unauthorized copying of this file via any medium is strictly prohibited
"""

#: Names with a version.
VERSIONED = r"""
apache-1.0 | apache (?:software )?licen[cs]e(?: version| v)? ?1 0
apache-1.1 | apache (?:software )?licen[cs]e(?: version| v)? ?1 1
apache-2.0 | apache (?:software )?(?:licen[cs]e )?(?:version |v)?2 0
apache-2.0 | apache (?:software )?licen[cs]e(?: version| v)? ?2
apache-2.0 | apache2(?: 0)? licen[cs]e
gpl-1.0 | (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?1(?: 0)?
gpl-2.0 | (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?2(?: 0)?(?: only| or later| or any later version)?
gpl-3.0 | (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?3(?: 0)?(?: only| or later| or any later version)?
gpl-2.0 | (?:gnu )?gpl ?v ?2(?: 0)?(?: only| or later)?
gpl-3.0 | (?:gnu )?gpl ?v ?3(?: 0)?(?: only| or later)?
gpl-2.0 | (?:gnu )?gpl version 2(?: 0)?(?: only| or later)?
gpl-3.0 | (?:gnu )?gpl version 3(?: 0)?(?: only| or later)?
lgpl-2.0 | (?:gnu )?library general public licen[cs]e(?: lgpl)?(?: version| v)? ?2(?: 0)?
lgpl-2.1 | (?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version| v)? ?2 1
lgpl-3.0 | (?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version| v)? ?3(?: 0)?
lgpl-2.1 | (?:gnu )?lgpl ?v ?2 1
lgpl-3.0 | (?:gnu )?lgpl ?v ?3(?: 0)?
agpl-1.0 | affero general public licen[cs]e(?: agpl)?(?: version| v)? ?1(?: 0)?
agpl-3.0 | (?:gnu )?affero general public licen[cs]e(?: agpl)?(?: version| v)? ?3(?: 0)?
agpl-3.0 | (?:gnu )?agpl ?v ?3(?: 0)?
gfdl-1.1 | (?:gnu )?free documentation licen[cs]e(?: version| v)? ?1 1
gfdl-1.2 | (?:gnu )?free documentation licen[cs]e(?: version| v)? ?1 2
gfdl-1.3 | (?:gnu )?free documentation licen[cs]e(?: version| v)? ?1 3
bsd-2-clause | (?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)?
bsd-2-clause | bsd 2 clause licen[cs]e
bsd-3-clause | (?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?
bsd-3-clause | bsd 3 clause licen[cs]e
bsd-4-clause | (?:original|old|4 clause|four clause) bsd(?: licen[cs]e)?
bsd-4-clause | bsd 4 clause licen[cs]e
0bsd | zero clause bsd(?: licen[cs]e)?
0bsd | bsd zero clause(?: licen[cs]e)?
mit-0 | mit no attribution(?: licen[cs]e)?
mpl-1.0 | mozilla public licen[cs]e(?: version| v)? ?1 0
mpl-1.1 | mozilla public licen[cs]e(?: version| v)? ?1 1
mpl-2.0 | mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
npl-1.1 | netscape public licen[cs]e(?: version| v)? ?1 1
epl-1.0 | eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
epl-2.0 | eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
edl-1.0 | eclipse distribution licen[cs]e(?: version| v)? ?1 0
cpl-1.0 | common public licen[cs]e(?: version| v)? ?1 0
cpal-1.0 | common public attribution licen[cs]e(?: version| v)? ?1 0
ibm-ipl-1.0 | ibm public licen[cs]e(?: version| v)? ?1 0
apsl-2.0 | apple public source licen[cs]e(?: version| v)? ?2 0
cddl-1.0 | common development and distribution licen[cs]e(?: cddl)?(?: version| v)? ?1 0
cddl-1.1 | common development and distribution licen[cs]e(?: cddl)?(?: version| v)? ?1 1
eupl-1.1 | european union public licen[cs]e(?: version| v)? ?1 1
eupl-1.2 | european union public licen[cs]e(?: version| v)? ?1 2
artistic-1.0 | artistic licen[cs]e(?: version| v)? ?1 0
artistic-2.0 | artistic licen[cs]e(?: version| v)? ?2(?: 0)?
afl-2.1 | academic free licen[cs]e(?: version| v)? ?2 1
afl-3.0 | academic free licen[cs]e(?: version| v)? ?3 0
osl-3.0 | open software licen[cs]e(?: version| v)? ?3 0
osl-2.1 | open software licen[cs]e(?: version| v)? ?2 1
bsl-1.0 | boost software licen[cs]e(?: version| v)? ?1 0
busl-1.1 | business source licen[cs]e(?: version| v)? ?1 1
sspl-1.0 | server side public licen[cs]e(?: version| v)? ?1(?: 0)?
elastic-2.0 | elastic licen[cs]e(?: version| v)? ?2(?: 0)?
ofl-1.1 | (?:sil )?open font licen[cs]e(?: version| v)? ?1 1
ofl-1.0 | (?:sil )?open font licen[cs]e(?: version| v)? ?1 0
odbl-1.0 | open database licen[cs]e(?: odbl)?(?: version| v)? ?1 0
upl-1.0 | universal permissive licen[cs]e(?: version| v)? ?1 0
ecl-2.0 | educational community licen[cs]e(?: version| v)? ?2 0
lppl-1.3c | latex project public licen[cs]e(?: version| v)? ?1 3c
cc0-1.0 | (?:creative commons )?cc0(?: universal)? 1 0(?: universal)?
cc0-1.0 | creative commons (?:cc0|zero)(?: universal)?(?: version| v)? ?1 0
cc-by-2.0 | creative commons attribution(?: generic| licen[cs]e)? 2 0
cc-by-3.0 | creative commons attribution(?: unported| licen[cs]e)? 3 0
cc-by-4.0 | creative commons attribution(?: international| licen[cs]e)? 4 0
cc-by-sa-2.0 | creative commons attribution share ?alike(?: licen[cs]e)? 2 0
cc-by-sa-3.0 | creative commons attribution share ?alike(?: unported| licen[cs]e)? 3 0
cc-by-sa-4.0 | creative commons attribution share ?alike(?: international| licen[cs]e)? 4 0
cc-by-nc-3.0 | creative commons attribution non ?commercial(?: unported| licen[cs]e)? 3 0
cc-by-nc-4.0 | creative commons attribution non ?commercial(?: international| licen[cs]e)? 4 0
cc-by-nd-3.0 | creative commons attribution no ?deriv(?:ative)?s?(?: unported| licen[cs]e)? 3 0
cc-by-nd-4.0 | creative commons attribution no ?deriv(?:ative)?s?(?: international| licen[cs]e)? 4 0
cc-by-nc-sa-3.0 | creative commons attribution non ?commercial share ?alike(?: licen[cs]e)? 3 0
cc-by-nc-sa-4.0 | creative commons attribution non ?commercial share ?alike(?: licen[cs]e)? 4 0
cc-by-nc-nd-4.0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: licen[cs]e)? 4 0
psf-2.0 | python software foundation licen[cs]e(?: version| v)? ?2(?: 0)?
php-3.0 | php licen[cs]e(?: version| v)? ?3 0
php-3.01 | php licen[cs]e(?: version| v)? ?3 01
zpl-2.1 | zope public licen[cs]e(?: zpl)?(?: version| v)? ?2 1
"""

#: Notices that name a licence as the one that holds.
NOTICES = r"""
mit | (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?mit(?: x11| expat)?(?: licen[cs]e)?
apache | (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[cs]e)?
gpl | (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)
lgpl | (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e)
agpl | (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:agpl|affero general public licen[cs]e)
bsd | (?:licensed|released|distributed|available|published|provided|covered) under (?:a |the )?(?:terms of )?(?:a |the )?bsd(?: style)?(?: licen[cs]e)?
isc | (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[cs]e)?
mpl | (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:mpl|mozilla public licen[cs]e)
epl | (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:epl|eclipse public licen[cs]e)
cc | (?:licensed|released|distributed|available|published|provided|covered) under (?:a |the )?(?:terms of )?(?:a |the )?creative commons
zlib | (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)?(?: licen[cs]e)?
unlicense | (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?unlicense
wtfpl | (?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?wtfpl
proprietary | all rights reserved (?:this (?:file|software) is )?(?:proprietary and confidential|confidential and proprietary)
proprietary | (?:this (?:file|software) is )?proprietary and confidential
public-domain | (?:released|placed|dedicated|given|put) (?:in|into|to) the public domain
public-domain | (?:this (?:work|file|software|code) )?is in the public domain
"""

#: Names alone.
NAMES = r"""
mit | mit(?: x11| expat)? licen[cs]e
apache | apache(?: software)? licen[cs]e
gpl | (?:gnu )?general public licen[cs]e
lgpl | (?:gnu )?lesser general public licen[cs]e
lgpl | (?:gnu )?library general public licen[cs]e
agpl | (?:gnu )?affero general public licen[cs]e
gfdl | (?:gnu )?free documentation licen[cs]e
bsd | bsd(?: style)? licen[cs]e
isc | isc licen[cs]e
x11 | x11 licen[cs]e
expat | expat licen[cs]e
mpl | mozilla public licen[cs]e
npl | netscape public licen[cs]e
epl | eclipse public licen[cs]e
edl | eclipse distribution licen[cs]e
cpl | common public licen[cs]e
cpal | common public attribution licen[cs]e
ibm-ipl | ibm public licen[cs]e
apsl | apple public source licen[cs]e
cddl | common development and distribution licen[cs]e
eupl | european union public licen[cs]e
cecill | cecill(?: free software)? licen[cs]e
artistic | (?:perl )?artistic licen[cs]e
zlib | zlib(?: libpng)? licen[cs]e
libpng | libpng licen[cs]e
bsl | boost software licen[cs]e
busl | business source licen[cs]e
sspl | server side public licen[cs]e
elastic | elastic licen[cs]e
unlicense | the unlicense
wtfpl | do what the \S+ you want to public licen[cs]e
python | python software foundation licen[cs]e
php | php licen[cs]e
ruby | ruby licen[cs]e
openssl | openssl(?: ssleay)? licen[cs]e
ofl | (?:sil )?open font licen[cs]e
odbl | open(?: data commons)?(?: open)? database licen[cs]e
pddl | public domain dedication and licen[cs]e
odc-by | open data commons attribution licen[cs]e
osl | open software licen[cs]e
afl | academic free licen[cs]e
ms-pl | microsoft public licen[cs]e
ms-rl | microsoft reciprocal licen[cs]e
ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
postgresql | postgresql licen[cs]e
upl | universal permissive licen[cs]e
w3c | w3c(?: software)?(?: notice and)? licen[cs]e
cc0 | creative commons (?:cc0|zero)
cc-by | creative commons attribution
cc-by-sa | creative commons attribution share ?alike
cc-by-nc | creative commons attribution non ?commercial
cc-by-nd | creative commons attribution no ?deriv(?:ative)?s?
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
ecl | educational community licen[cs]e
lppl | latex project public licen[cs]e
zpl | zope public licen[cs]e
blueoak | blue oak model licen[cs]e
mulan-psl | mulan permissive software licen[cs]e
openldap | openldap public licen[cs]e
sleepycat | sleepycat licen[cs]e
beerware | beer ?ware licen[cs]e
vim | vim licen[cs]e
commons-clause | commons clause licen[cs]e condition
hippocratic | hippocratic licen[cs]e
public-domain | (?:in|into|to) the public domain
dual | dual licensed under
"""

#: Sections in order: rules, priority, relevance.
SECTIONS = ((IDENTIFIERS, 90, 1.0), (BODIES, 80, 0.95), (VERSIONED, 70, 0.9), (NOTICES, 60, 0.8), (NAMES, 40, 0.7))
