"""The signatures of the license scan, in order: names in usual phrases, and sentences of licenses and their notices."""

from __future__ import annotations

import re

# a word is a run of 0-9, A-Z, a-z and all beyond ASCII
WORD_CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
LEVELS = 5

# Label, keywords (lower case, parted by '|'; every match holds one of them), name. A blank stands for white
# space, ' ?' for white space that may be left out, '[ -]' for one blank or hyphen.
NAMES = [
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[sc]e)?,?[ -]?(?:version |v)?2(?:\.0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[sc]e)?,?[ -]?(?:version |v)?1\.1"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: licen[sc]e)?,?[ -]?(?:version |v)?1\.0"),
    ("apache", "apache", r"apache"),
    ("mit-0", "mit", r"mit(?: no attribution|-0)"),
    ("mit", "mit", r"(?:the )?(?:expat/)?mit"),
    ("expat", "expat", r"expat"),
    ("x11", "x11", r"(?:mit/)?x11"),
    ("agpl-3.0", "affero|agpl", r"(?:(?:gnu )?affero general public licen[sc]e|(?:gnu )?agpl),?[ -]?(?:version |v)?3(?:\.0)?"),
    ("lgpl-3.0", "lesser|library|lgpl", r"(?:(?:gnu )?(?:lesser|library) general public licen[sc]e|(?:gnu )?lgpl),?[ -]?(?:version |v)?3(?:\.0)?"),
    ("lgpl-2.1", "lesser|library|lgpl", r"(?:(?:gnu )?(?:lesser|library) general public licen[sc]e|(?:gnu )?lgpl),?[ -]?(?:version |v)?2\.1"),
    ("lgpl-2.0", "lesser|library|lgpl", r"(?:(?:gnu )?(?:lesser|library) general public licen[sc]e|(?:gnu )?lgpl),?[ -]?(?:version |v)?2(?:\.0)?"),
    ("gpl-3.0", "general public|gpl", r"(?:(?:gnu )?general public licen[sc]e|(?:gnu )?gpl),?[ -]?(?:version |v)?3(?:\.0)?"),
    ("gpl-2.0", "general public|gpl", r"(?:(?:gnu )?general public licen[sc]e|(?:gnu )?gpl),?[ -]?(?:version |v)?2(?:\.0)?"),
    ("lgpl-any", "lesser|library|lgpl", r"(?:gnu )?(?:(?:lesser|library) general public|lgpl)"),
    ("agpl-any", "affero|agpl", r"(?:gnu )?(?:affero general public|agpl)"),
    ("gpl-any", "general public|gpl", r"(?:gnu )?(?:general public|gpl)"),
    ("gfdl", "documentation|gfdl", r"(?:(?:gnu )?free documentation|gfdl)"),
    ("bsd-2-clause", "2-clause|two-clause|simplified|freebsd", r"(?:2-clause|two-clause|simplified|freebsd)(?: bsd)?|bsd[ -](?:2-clause|two-clause)"),
    ("bsd-3-clause", "bsd", r"(?:3-clause|three-clause|new|modified|revised) bsd|bsd[ -](?:3-clause|three-clause)"),
    ("bsd-4-clause", "bsd", r"(?:4-clause|four-clause|original) bsd|bsd[ -](?:4-clause|four-clause)"),
    ("0bsd", "bsd", r"(?:zero[ -]clause bsd|0bsd)"),
    ("bsd", "bsd", r"bsd(?:-style)?"),
    ("mpl-2.0", "mozilla|mpl", r"(?:mozilla public licen[sc]e|mpl),?[ -]?(?:version |v)?2(?:\.0)?"),
    ("mpl-1.1", "mozilla|mpl", r"(?:mozilla public licen[sc]e|mpl),?[ -]?(?:version |v)?1\.1"),
    ("mpl", "mozilla|mpl", r"(?:mozilla public|mpl)"),
    ("epl-2.0", "eclipse|epl", r"(?:eclipse public licen[sc]e(?: -)?|epl),?[ -]?(?:version |v)?2(?:\.0)?"),
    ("epl-1.0", "eclipse|epl", r"(?:eclipse public licen[sc]e(?: -)?|epl),?[ -]?(?:version |v)?1(?:\.0)?"),
    ("epl", "eclipse|epl", r"(?:eclipse public|epl)"),
    ("eupl", "european|eupl", r"(?:european union public|eupl)"),
    ("cddl", "development and distribution|cddl", r"(?:common development and distribution|cddl)"),
    ("cc-by-4.0", "cc by|cc-by", r"cc[ -]by[ -]?4\.0"),
    ("cc-by-3.0", "cc by|cc-by", r"cc[ -]by[ -]?3\.0"),
    ("cc-by-sa", "cc by|cc-by", r"cc[ -]by-sa(?:[ -][1-4]\.[05])?"),
    ("cc-by-nc", "cc by|cc-by", r"cc[ -]by-nc(?:[ -][1-4]\.[05])?"),
    ("cc-by-nd", "cc by|cc-by", r"cc[ -]by-nd(?:[ -][1-4]\.[05])?"),
    ("cc-by-nc-sa", "cc by|cc-by", r"cc[ -]by-nc-sa(?:[ -][1-4]\.[05])?"),
    ("cc-by-nc-nd", "cc by|cc-by", r"cc[ -]by-nc-nd(?:[ -][1-4]\.[05])?"),
    ("cc0", "cc0", r"cc0(?:[ -]1\.0)?"),
    ("cc", "creative commons", r"creative commons(?: attribution)?(?:[ -](?:non-?commercial|share-?alike|no-?derivatives))*(?: [1-4]\.[05])?"),
    ("isc", "isc", r"isc"),
    ("boost-1.0", "boost|bsl", r"(?:boost software|bsl-1\.0)"),
    ("zlib", "zlib", r"zlib(?:/libpng)?"),
    ("artistic", "artistic", r"artistic"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "do what|wtfpl", r"(?:do what the fuck you want to public|wtfpl)"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python", "python", r"python(?: software foundation)?"),
    ("php", "php", r"php"),
    ("openssl", "openssl", r"openssl"),
    ("ncsa", "illinois", r"university of illinois(?:/ncsa)?(?: open source)?"),
    ("ofl-1.1", "open font|ofl", r"(?:(?:sil )?open font|ofl)"),
    ("odbl", "open database|odbl", r"(?:(?:open data commons )?open database|odbl)"),
    ("odc-by", "open data", r"open data commons attribution"),
    ("busl", "business source", r"business source"),
    ("sspl", "server side|sspl", r"(?:server side public|sspl)"),
    ("elastic", "elastic", r"elastic"),
    ("openrail", "rail", r"(?:open|bigscience )rail(?:-m)?"),
    ("llama", "llama", r"llama(?: [234](?:\.[0-9])?)?(?: community)?"),
    ("ms-pl", "microsoft|ms-pl", r"(?:microsoft (?:public|reciprocal)|ms-pl)"),
]
# What stands around a name, and the priority of such a finding.
FORMS = [
    (r"spdx-license-identifier ?: ?{id}", 5),
    (r"(?:is |are |be )?(?:re)?licen[sc]ed (?:to you )?under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[sc]e)?(?:, version [0-9.]*[0-9])?", 4),
    (r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{name} licen[sc]e(?:, version [0-9.]*[0-9])?", 4),
    (r"(?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?{name} licen[sc]e", 3),
    (r"licen[sc]e ?[:=] ?(?:the )?{name}", 3),
    (r"{name} licen[sc]e", 2),
]
#: Names that are findings by themselves.
ALONE = ("cc-by-4.0", "cc-by-3.0", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "cc0", "cc", "agpl-3.0", "lgpl-3.0", "lgpl-2.1", "lgpl-2.0", "gpl-3.0", "gpl-2.0", "bsd-3-clause", "bsd-4-clause", "apache-2.0")

# Label, priority, sentence. Sentences of licenses, of notices and of grants; 'licen[sc]e' is either spelling.
SIGNATURES = [
    ("apache-2.0", 4, r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", 4, r"unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e"),
    ("apache-2.0", 5, r"(?:http|https)://www\.apache\.org/licen[sc]es/licen[sc]e-2\.0"),
    ("apache-2.0", 4, r"terms and conditions for use, reproduction, and distribution"),
    ("apache-2.0", 3, r"to the apache software foundation \(asf\) under one or more contributor licen[sc]e agreements"),
    ("apache-1.1", 4, r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", 3, r"products derived from this software may not be called ['\x22]?apache"),
    ("mit", 4, r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", 4, r"without restriction, including without limitation the rights to use, copy, modify, merge, publish"),
    ("mit", 4, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", 3, r"the software is provided ['\x22]as is['\x22], without warranty of any kind, express or implied"),
    ("mit", 3, r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability"),
    ("mit", 5, r"(?:http|https)://(?:www\.)?opensource\.org/licen[sc]es/mit"),
    ("mit", 3, r"may be freely distributed under the mit"),
    ("x11", 4, r"except as contained in this notice, the name of the x consortium shall not be used"),
    ("bsd", 4, r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-2-clause", 4, r"redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("bsd-2-clause", 4, r"redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    ("bsd-3-clause", 4, r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", 4, r"may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 4, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause", 3, r"this product includes software developed by the university of california, berkeley"),
    ("bsd", 3, r"this software is provided by the copyright holders and contributors ['\x22]as is['\x22]"),
    ("bsd", 3, r"use of this source code is governed by a bsd-style licen[sc]e"),
    ("bsd", 5, r"(?:http|https)://(?:www\.)?opensource\.org/licen[sc]es/bsd-"),
    ("0bsd", 4, r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\."),
    ("isc", 4, r"permission to use, copy, modify,? and/?(?:or)? ?distribute this software for any purpose with or without fee is hereby granted, provided"),
    ("isc", 3, r"the author disclaims all warranties with regard to this software including all implied warranties"),
    ("isc", 5, r"(?:http|https)://(?:www\.)?opensource\.org/licen[sc]es/isc"),
    ("gpl-any", 4, r"you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-2.0", 4, r"either version 2 of the licen[sc]e, or \(at your option\) any later version"),
    ("gpl-3.0", 4, r"either version 3 of the licen[sc]e, or \(at your option\) any later version"),
    ("lgpl-2.1", 4, r"either version 2\.1 of the licen[sc]e, or \(at your option\) any later version"),
    ("gpl-any", 3, r"you should have received a copy of the gnu general public licen[sc]e along with this"),
    ("lgpl-any", 3, r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this"),
    ("agpl-any", 3, r"you should have received a copy of the gnu affero general public licen[sc]e along with this"),
    ("lgpl-any", 4, r"under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl-any", 4, r"under the terms of the gnu affero general public licen[sc]e"),
    ("gpl-any", 3, r"it will be useful, but without any warranty; without even the implied warranty of merchantability"),
    ("gpl-any", 4, r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document"),
    ("gpl-2.0", 3, r"free software foundation, inc\., (?:59 temple place|51 franklin st).{0,60}? usa"),
    ("gpl-3.0", 3, r"the gnu general public licen[sc]e is a free, copyleft licen[sc]e for software"),
    ("agpl-3.0", 3, r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("lgpl-2.1", 3, r"this is the first released version of the lesser gpl"),
    ("gpl-any", 5, r"(?:http|https)://www\.gnu\.org/licen[sc]es/gpl"),
    ("lgpl-any", 5, r"(?:http|https)://www\.gnu\.org/licen[sc]es/lgpl"),
    ("agpl-any", 5, r"(?:http|https)://www\.gnu\.org/licen[sc]es/agpl"),
    ("gpl-2.0", 4, r"gplv2 (?:only|or later)"),
    ("gpl-3.0", 4, r"gplv3 (?:only|or later)"),
    ("gpl-classpath", 4, r"as a special exception, the copyright holders of this library give you permission to link this library"),
    ("gcc-exception", 4, r"gcc runtime library exception"),
    ("gfdl", 4, r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation"),
    ("gfdl", 3, r"with no invariant sections, no front-cover texts,? and no back-cover texts"),
    ("mpl-2.0", 4, r"this source code form is subject to the terms of the mozilla public licen[sc]e, v\. 2\.0"),
    ("mpl-2.0", 3, r"if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", 4, r"the contents of this file are subject to the mozilla public licen[sc]e version 1\.1"),
    ("mpl", 5, r"(?:http|https)://(?:www\.)?mozilla\.org/mpl"),
    ("npl", 4, r"the contents of this file are subject to the netscape public licen[sc]e"),
    ("epl-2.0", 4, r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e 2\.0"),
    ("epl-1.0", 4, r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1\.0"),
    ("epl", 5, r"(?:http|https)://www\.eclipse\.org/(?:legal/epl|org/documents/epl)"),
    ("cpl-1.0", 4, r"the accompanying program is provided under the terms of this common public licen[sc]e"),
    ("ipl-1.0", 4, r"the accompanying program is provided under the terms of this ibm public licen[sc]e"),
    ("cddl", 4, r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("eupl", 4, r"licen[sc]ed under the eupl"),
    ("cecill", 4, r"governed by the cecill(?:-[bc])? licen[sc]e"),
    ("cecill", 3, r"abiding by the rules of distribution of free software"),
    ("boost-1.0", 4, r"distributed under the boost software licen[sc]e, version 1\.0"),
    ("boost-1.0", 3, r"unless such copies or derivative works are solely in the form of machine-executable object code"),
    ("zlib", 4, r"this software is provided ['\x22]as-is['\x22], without any express or implied warranty"),
    ("zlib", 3, r"the origin of this software must not be misrepresented"),
    ("zlib", 3, r"altered source versions must be plainly marked as such"),
    ("libpng", 4, r"this copy of the libpng notices is provided for your convenience"),
    ("unlicense", 4, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 5, r"(?:http|https)://unlicense\.org"),
    ("unlicense", 3, r"the unlicense"),
    ("mit", 3, r"mit[ -]licen[sc]ed"),
    ("mpl-2.0", 3, r"mozilla public licen[sc]e,? (?:version |v\.? ?)?2\.0"),
    ("epl-2.0", 3, r"eclipse public licen[sc]e,? (?:- )?(?:version |v\.? ?)?2\.0"),
    ("cc-by-4.0", 3, r"creative commons attribution 4\.0"),
    ("cc0", 5, r"(?:http|https)://creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc0", 4, r"has waived all copyright and related or neighbou?ring rights"),
    ("cc0", 3, r"to the extent possible under law, .{1,80}? waived all copyright"),
    ("cc-pdm", 5, r"(?:http|https)://creativecommons\.org/publicdomain/mark/1\.0"),
    ("cc-by", 5, r"(?:http|https)://creativecommons\.org/licen[sc]es/by/[1-4]\.[05]"),
    ("cc-by-sa", 5, r"(?:http|https)://creativecommons\.org/licen[sc]es/by-sa/[1-4]\.[05]"),
    ("cc-by-nc", 5, r"(?:http|https)://creativecommons\.org/licen[sc]es/by-nc/[1-4]\.[05]"),
    ("cc-by-nd", 5, r"(?:http|https)://creativecommons\.org/licen[sc]es/by-nd/[1-4]\.[05]"),
    ("cc-by-nc-sa", 5, r"(?:http|https)://creativecommons\.org/licen[sc]es/by-nc-sa/[1-4]\.[05]"),
    ("cc-by-nc-nd", 5, r"(?:http|https)://creativecommons\.org/licen[sc]es/by-nc-nd/[1-4]\.[05]"),
    ("cc-by", 4, r"creative commons attribution [1-4]\.[05] (?:international|unported|generic)"),
    ("cc-by-sa", 4, r"creative commons attribution[ -]share-?alike [1-4]\.[05] (?:international|unported|generic)"),
    ("cc-by-nc", 4, r"creative commons attribution[ -]non-?commercial [1-4]\.[05] (?:international|unported|generic)"),
    ("cc-by-nc-sa", 4, r"creative commons attribution[ -]non-?commercial[ -]share-?alike [1-4]\.[05]"),
    ("cc-by-nc-nd", 4, r"creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s [1-4]\.[05]"),
    ("cc", 3, r"you are free to share, copy and redistribute the material in any medium or format"),
    ("cc", 3, r"you must give appropriate credit, provide a link to the licen[sc]e, and indicate if changes were made"),
    ("cc-by-nc", 3, r"you may not use the material for commercial purposes"),
    ("cc-by-nd", 3, r"you may not distribute the modified material"),
    ("cc-by-sa", 3, r"you must distribute your contributions under the same licen[sc]e as the original"),
    ("artistic", 4, r"under the same terms as perl itself"),
    ("artistic", 3, r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", 4, r"the artistic licen[sc]e 2\.0"),
    ("python", 4, r"psf is making python available to licen[sc]ee on an ['\x22]as is['\x22] basis"),
    ("python", 3, r"python software foundation licen[sc]e version 2"),
    ("php", 4, r"this source file is subject to version [23]\.[01]+ of the php licen[sc]e"),
    ("postgresql", 4, r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee"),
    ("openssl", 4, r"this product includes software developed by the openssl project"),
    ("ssleay", 4, r"this product includes cryptographic software written by eric young"),
    ("ncsa", 4, r"to deal with the software without restriction, including without limitation the rights to use"),
    ("ofl-1.1", 4, r"this font software is licen[sc]ed under the sil open font licen[sc]e"),
    ("ofl-1.1", 5, r"(?:http|https)://scripts\.sil\.org/ofl"),
    ("ofl-1.1", 3, r"the font software may be modified, altered, or added to"),
    ("wtfpl", 4, r"you just do what the fuck you want to"),
    ("beerware", 4, r"the beer-?ware licen[sc]e"),
    ("json", 4, r"the software shall be used for good, not evil"),
    ("curl", 4, r"except as contained in this notice, the name of a copyright holder shall not be used in advertising"),
    ("ijg", 4, r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", 4, r"portions of this software are copyright .{1,40}? the freetype project"),
    ("unicode", 4, r"to deal in the data files or software without restriction"),
    ("w3c", 4, r"by obtaining, using and/or copying this work, you \(the licen[sc]ee\) agree"),
    ("zpl", 4, r"subject to the provisions of the zope public licen[sc]e"),
    ("ms-pl", 4, r"this licen[sc]e governs use of the accompanying software\. if you use the software, you accept this licen[sc]e"),
    ("odbl", 5, r"(?:http|https)://(?:www\.)?opendatacommons\.org/licen[sc]es/odbl"),
    ("odbl", 4, r"available under the open database licen[sc]e"),
    ("odc-by", 5, r"(?:http|https)://(?:www\.)?opendatacommons\.org/licen[sc]es/by"),
    ("pddl", 5, r"(?:http|https)://(?:www\.)?opendatacommons\.org/licen[sc]es/pddl"),
    ("pddl", 4, r"public domain dedication and licen[sc]e"),
    ("ogl-uk", 4, r"contains public sector information licen[sc]ed under the open government licen[sc]e"),
    ("ogl-uk", 3, r"open government licen[sc]e v[123]\.0"),
    ("etalab", 3, r"licen[sc]e ouverte"),
    ("dl-de-by", 3, r"datenlizenz deutschland"),
    ("busl", 4, r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use"),
    ("busl", 3, r"change licen[sc]e: .{1,40}?[0-9]"),
    ("sspl", 4, r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", 4, r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 4, r"the grant of rights under the licen[sc]e will not include, and the licen[sc]e does not grant to you, the right to sell"),
    ("polyform", 3, r"polyform (?:noncommercial|small business|shield|perimeter|strict) licen[sc]e"),
    ("openrail", 3, r"use-based restrictions as referenced in paragraph 5"),
    ("llama", 3, r"additional commercial terms\. if, on the .{1,40}? version release date"),
    ("gemma", 3, r"gemma terms of use"),
    ("bsd-2-clause", 2, r"bsd[ -](?:2|two)[ -]clause"),
    ("copyright", 1, r"copyright (?:\(c\) |© )?[12][0-9]{3}(?:[-,] ?[12][0-9]{3})*"),
    ("copyright", 1, r"copyright (?:\(c\)|©)"),
    ("copyright", 1, r"(?:\(c\)|©) copyright"),
    ("copyright", 1, r"copyright by"),
    ("copyright", 1, r"this work is protected by copyright"),
    ("reserved-all", 1, r"all rights reserved"),
    ("reserved-all", 1, r"alle rechte vorbehalten"),
    ("reserved-all", 1, r"tous droits réservés"),
    ("reserved-all", 1, r"todos los derechos reservados"),
    ("reserved-some", 1, r"some rights reserved"),
    ("public-domain", 3, r"(?:released|dedicated|placed) (?:in|to|into) the public domain"),
    ("public-domain", 3, r"is in the public domain"),
    ("public-domain", 3, r"this work has been identified as being free of known restrictions under copyright law"),
    ("public-domain", 3, r"a work of the united states government"),
    ("no-redistribution", 2, r"may not (?:be )?(?:copy|copied|redistributed?|distributed?) .{0,60}?permission"),
    ("no-redistribution", 2, r"may not (?:be )?(?:copy|copied|redistributed?|distributed?) .{0,60}?licen[sc]e"),
    ("no-redistribution", 2, r"may not (?:be )?(?:copy|copied|redistributed?|distributed?) .{0,60}?rights"),
    ("no-redistribution", 2, r"must not (?:be )?(?:copy|copied|redistributed?|distributed?) .{0,60}?permission"),
    ("no-redistribution", 2, r"must not (?:be )?(?:copy|copied|redistributed?|distributed?) .{0,60}?licen[sc]e"),
    ("no-redistribution", 2, r"must not (?:be )?(?:copy|copied|redistributed?|distributed?) .{0,60}?rights"),
    ("no-redistribution", 2, r"no rights? to (?:be )?(?:copy|copied|redistributed?|distributed?) .{0,60}?permission"),
    ("no-redistribution", 2, r"no rights? to (?:be )?(?:copy|copied|redistributed?|distributed?) .{0,60}?licen[sc]e"),
    ("no-redistribution", 2, r"no rights? to (?:be )?(?:copy|copied|redistributed?|distributed?) .{0,60}?rights"),
    ("no-redistribution", 2, r"no part of this (?:publication|book|work|document) may be reproduced"),
    ("no-redistribution", 2, r"without the prior written permission of the (?:publisher|author|copyright (?:owner|holder))"),
    ("no-redistribution", 2, r"unauthori[sz]ed (?:copying|reproduction|distribution|use) of this"),
    ("proprietary", 2, r"this software is the confidential and proprietary information of"),
    ("proprietary", 2, r"proprietary and confidential"),
    ("proprietary", 2, r"is licen[sc]ed, not sold"),
    ("proprietary", 2, r"end[ -]user licen[sc]e agreement"),
    ("non-commercial", 2, r"for (?:personal|private|academic|research|educational),? (?:and )?non-?commercial use only"),
    ("non-commercial", 2, r"not for commercial use"),
    ("non-commercial", 2, r"commercial use is (?:prohibited|not permitted|forbidden)"),
    ("no-training", 2, r"may not be used (?:for|to) (?:the )?train(?:ing)?"),
    ("no-training", 2, r"text and data mining rights? (?:is|are) reserved"),
    ("attribution", 2, r"reproduced (?:here )?(?:with|by) (?:kind )?permission"),
    ("attribution", 2, r"used (?:with|by) permission"),
    ("fair-use", 2, r"constitutes (?:a )?fair use"),
    ("free-use", 2, r"(?:free|freely) to (?:use|copy|redistribute) and modify"),
    ("licensed", 1, r"see (?:the )?(?:file )?licen[sc]e(?:\.txt|\.md)? for (?:more )?(?:details|information|licen[sc]ing|terms)"),
    ("licensed", 1, r"licen[sc]e file in the root"),
    ("licensed", 1, r"licen[sc]ed under the terms"),
    ("dual", 2, r"dual[ -]licen[sc]ed under"),
]


def spaced(pattern: str) -> str:
    """Blanks of a signature as white space of a text."""
    return pattern.replace(" ?", r"\s*").replace("[ -]", r"[\s-]").replace("[- ]", r"[-\s]").replace(" ", r"\s+")


def literals(pattern: str) -> list[str]:
    """Runs of letters, digits, blanks and '-/:' that every match of a signature holds: what stands outside of groups, classes and optional parts. Longest first."""
    depth, bare = 0, []
    text = re.sub(r"\[[^\]]*\]|\\.|\{[^}]*\}", "\n", pattern)
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        optional = text[i + 1 : i + 2] in ("?", "*")
        bare.append(c if not depth and not optional and (c.isalnum() or c in " -/:") else "\n")
    return sorted((run.strip().lower() for run in "".join(bare).split("\n")), key=len, reverse=True)


def rules() -> list[tuple[str, str, str, int]]:
    """label, keywords, pattern, priority (1 to LEVELS); earlier rules win between equal findings."""
    out = []
    for form, priority in FORMS:
        for label, keyword, name in NAMES:
            own = form.replace("{name}", f"(?:{name})").replace("{id}", label.replace(".", r"\.").replace("-", "[- ]?") + r"(?:-only|-or-later)?")
            out.append((label, "spdx" if "spdx" in form else keyword, own, priority))
    out += [(label, literals(pattern)[0], pattern, priority) for label, priority, pattern in SIGNATURES]
    out += [(label, keyword, name, 2) for label, keyword, name in NAMES if label in ALONE]
    return [(a, k, rf"(?i)(?<!{WORD_CHAR})(?:{spaced(p)})(?!{WORD_CHAR})", n) for a, k, p, n in out]
