"""Hand-written signatures of operator 9: sentences and headings by which licenses are told, one rule each.

(label, priority, confidence, keyword, regex over the words). Every match holds the keyword. Priorities as in ``licenses``: 3 a license
with its version or its own wording, 2 a license by name, 1 generic wording that a better match may contain. A negative look-ahead
or look-behind is a rule's exception.
"""

SIGNATURES = [
    # --- MIT and its kin
    ("mit-text", 3, 0.95, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-text", 3, 0.9, "copies or substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-text", 2, 0.8, "to deal in the software without restriction", "to deal in the software without restriction including without limitation the rights"),
    ("mit", 2, 0.85, "mit licen", "(?:released|distributed|available|licensed|published|provided)(?: freely)? under (?:the )?(?:terms of the )?mit licen[cs]e"),
    ("mit", 2, 0.8, "mit licensed", "(?:is|are) mit licensed"),
    ("mit", 2, 0.8, "license mit", "license mit(?! or)"),
    ("mit-0", 3, 0.95, "mit no attribution", "mit no attribution(?: license)?"),
    ("mit-modern", 3, 0.9, "modern variant of the mit", "modern variant of the mit license"),
    ("x11", 3, 0.9, "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc-text", 3, 0.9, "permission to use copy modify", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 2, 0.85, "isc licen", "(?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?isc licen[cs]e"),
    ("hpnd", 3, 0.85, "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("ntp", 3, 0.85, "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("fair", 3, 0.8, "usage of the works is permitted", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("curl", 3, 0.85, "copyright c 1996", "copyright c 1996 20[0-9]{2} daniel stenberg"),
    ("icu", 3, 0.85, "icu licen", "icu licen[cs]e(?: icu 1 8 1 and later)?"),
    ("unicode", 3, 0.9, "unicode licen", "unicode licen[cs]e(?: agreement| v3)?"),
    # --- BSD
    ("bsd-text", 3, 0.9, "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-text", 3, 0.9, "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 3, 0.9, "endorse or promote products", "neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|the|any) (?:[^ ]+ ){0,4}contributors may be used to endorse or promote products"),
    ("bsd-3-clause", 3, 0.85, "endorse or promote products", "may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-4-clause", 3, 0.9, "advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", 2, 0.85, "bsd 2", "bsd 2 clause (?:simplified|freebsd)? ?licen[cs]e"),
    ("bsd-2-clause-patent", 3, 0.9, "bsd 2 clause plus patent", "bsd 2 clause plus patent"),
    ("bsd-3-clause-clear", 3, 0.9, "bsd 3 clause clear", "bsd 3 clause clear"),
    ("bsd-3-clause-lbnl", 3, 0.9, "lawrence berkeley", "lawrence berkeley national labs? bsd variant licen[cs]e"),
    ("bsd", 2, 0.8, "bsd licen", "(?:released|distributed|available|licensed) under (?:a|the) bsd licen[cs]e"),
    ("bsd", 2, 0.75, "berkeley software distribution", "berkeley software distribution licen[cs]e"),
    # --- Apache
    ("apache-2.0", 3, 1.0, "apache org licenses license 2 0", "(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", 3, 0.95, "apache license version 2 0 the license", "licensed under the apache license version 2 0 the license"),
    ("apache-text", 3, 0.9, "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-text", 2, 0.8, "licensed to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 3, 0.9, "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache", 2, 0.8, "apache licen", "(?:released|distributed|available) under (?:the )?(?:terms of the )?apache licen[cs]e(?! version)"),
    ("llvm-exception", 3, 0.95, "llvm exception", "apache (?:license )?(?:v|version )?2 0 with llvm exceptions?"),
    # --- GNU
    ("gpl-text", 3, 0.9, "under the terms of the gnu general public", "under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("gpl-2.0-or-later", 3, 0.95, "either version 2 of the license", "gnu general public licen[cs]e as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 3, 0.95, "either version 3 of the license", "gnu general public licen[cs]e as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-only", 3, 0.95, "gpl", "gpl (?:v|version )?2(?: 0)? only"),
    ("gpl-3.0-only", 3, 0.95, "gpl", "(?<!a)(?<!l)gpl (?:v|version )?3(?: 0)? only"),
    ("lgpl-text", 3, 0.9, "gnu lesser general public", "under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation"),
    ("lgpl-2.1-or-later", 3, 0.95, "gnu lesser general public", "gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-text", 3, 0.9, "gnu library general public", "under the terms of the gnu library general public licen[cs]e as published by the free software foundation"),
    ("agpl-text", 3, 0.9, "gnu affero general public", "under the terms of the gnu affero general public licen[cs]e as published by the free software foundation"),
    ("agpl-3.0-or-later", 3, 0.95, "gnu affero general public", "gnu affero general public licen[cs]e (?:[^ ]+ ){0,12}either version 3 (?:of the license )?or at your option any later version"),
    ("gpl-warranty", 2, 0.7, "without even the implied warranty", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e"),
    ("gpl", 2, 0.75, "copy of the gnu general public", "you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("gpl-classpath-exception", 3, 0.95, "classpath exception", "(?:with (?:the )?)?classpath exception"),
    ("gpl-linking-exception", 3, 0.85, "as a special exception", "as a special exception (?:[^ ]+ ){0,12}(?:permission to link|to link)"),
    ("gpl-font-exception", 3, 0.9, "font exception", "gpl (?:[^ ]+ ){0,4}(?:with )?font exception"),
    ("gcc-exception", 3, 0.95, "gcc runtime library exception", "gcc runtime library exception"),
    ("gfdl-text", 3, 0.9, "gnu free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gpl-or-commercial", 3, 0.8, "commercial licen", "(?:gpl|general public licen[cs]e) or (?:a |under a )?commercial licen[cs]e"),
    # --- Mozilla, Eclipse, Sun and other weak copyleft
    ("mpl-2.0", 3, 1.0, "mozilla public", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-1.1", 3, 0.95, "mozilla public", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-2.0", 3, 0.9, "mozilla org mpl", "mozilla org mpl 2 0"),
    ("mpl-incompatible", 3, 0.9, "incompatible with secondary licen", "incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e"),
    ("npl", 3, 0.9, "netscape public licen", "netscape public licen[cs]e(?: version 1 [01])?"),
    ("epl-2.0", 3, 0.95, "eclipse org legal epl", "eclipse org legal epl (?:v20|2 0)"),
    ("epl-1.0", 3, 0.95, "eclipse org legal epl", "eclipse org legal epl v10"),
    ("edl-1.0", 3, 0.95, "eclipse distribution licen", "eclipse distribution licen[cs]e v(?:ersion)? ?1 0"),
    ("cddl-text", 3, 0.9, "common development and distribution", "the contents of this file are subject to the terms of (?:either )?(?:[^ ]+ ){0,12}the common development and distribution licen[cs]e"),
    ("cpl-1.0", 3, 0.9, "common public licen", "common public licen[cs]e (?:v|version )1 0"),
    ("ipl-1.0", 3, 0.9, "ibm public licen", "ibm public licen[cs]e(?: version 1 0)?"),
    ("spl-1.0", 3, 0.9, "sun public licen", "sun public licen[cs]e(?: version 1 0)?"),
    ("sissl", 3, 0.9, "sun industry standards source licen", "sun industry standards source licen[cs]e"),
    ("apsl-2.0", 3, 0.9, "apple public source licen", "apple public source licen[cs]e(?: version 2 0)?"),
    ("rpl-1.5", 3, 0.9, "reciprocal public licen", "reciprocal public licen[cs]e(?: 1 [15])?"),
    ("cpal-1.0", 3, 0.9, "common public attribution licen", "common public attribution licen[cs]e"),
    ("qpl-1.0", 3, 0.9, "q public licen", "q public licen[cs]e"),
    ("sleepycat", 3, 0.9, "sleepycat licen", "sleepycat licen[cs]e"),
    ("oclc-2.0", 3, 0.9, "oclc research public licen", "oclc research public licen[cs]e"),
    ("nasa-1.3", 3, 0.9, "nasa open source agreement", "nasa open source agreement(?: version 1 3)?"),
    ("upl-1.0", 3, 0.9, "universal permissive licen", "universal permissive licen[cs]e(?: v(?:ersion)? ?1 0)?"),
    ("mulan-psl-2.0", 3, 0.9, "mulan psl", "mulan psl v ?2"),
    ("blueoak-1.0.0", 3, 0.9, "blue oak model licen", "blue oak model licen[cs]e(?: 1 0 0)?"),
    ("ms-pl", 3, 0.9, "microsoft public licen", "microsoft public licen[cs]e ms pl"),
    ("boost-1.0", 3, 0.95, "boost org license 1 0", "boost org license 1 0"),
    ("boost-text", 3, 0.9, "boost software licen", "distributed under the boost software licen[cs]e version 1 0"),
    # --- short permissive
    ("zlib-text", 3, 0.9, "must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib-text", 2, 0.8, "altered source versions", "altered source versions must be plainly marked as such"),
    ("libpng-2.0", 3, 0.9, "png reference library licen", "png reference library licen[cs]e version 2"),
    ("unlicense-text", 3, 0.95, "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 3, 0.9, "wtfpl", "wtfpl (?:v|version )?2"),
    ("beerware-text", 3, 0.9, "you can buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("postgresql-text", 3, 0.85, "without a written agreement", "without a written agreement is hereby granted provided that the above copyright notice"),
    ("openssl-text", 3, 0.9, "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("psf-2.0", 3, 0.9, "psf license agreement", "psf license agreement for python"),
    ("python-text", 3, 0.85, "python software foundation licen", "python software foundation licen[cs]e version 2"),
    ("zpl-2.1", 3, 0.9, "zope public licen", "zope public licen[cs]e zpl version 2 1"),
    ("tcl", 3, 0.85, "tcl licen", "tcl tk licen[cs]e"),
    ("ftl", 3, 0.9, "freetype project licen", "freetype project licen[cs]e"),
    ("ijg", 3, 0.85, "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("info-zip", 3, 0.9, "info zip licen", "info zip licen[cs]e"),
    ("artistic-2.0", 3, 0.9, "artistic license 2 0", "the artistic license 2 0"),
    ("perl", 2, 0.85, "same terms as perl itself", "under the same terms as perl itself"),
    # --- fonts, data, documents, media
    ("ofl-1.1", 3, 0.95, "sil open font licen", "licensed under the sil open font licen[cs]e version 1 1"),
    ("ofl", 2, 0.85, "reserved font name", "with reserved font name"),
    ("cc0-1.0", 3, 0.95, "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", 3, 0.95, "cc0 1 0", "cc0 1 0 universal(?: public domain dedication)?"),
    ("cc-pdm", 3, 0.9, "creativecommons org publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc", 2, 0.85, "creative commons", "creative commons (?:[^ ]+ ){0,3}non ?commercial licen[cs]e"),
    ("odc-by-1.0", 3, 0.9, "open data commons attribution licen", "open data commons attribution licen[cs]e"),
    ("odbl-1.0", 3, 0.9, "open data commons open database licen", "open data commons open database licen[cs]e"),
    ("pddl-1.0", 3, 0.9, "public domain dedication and licen", "public domain dedication and licen[cs]e"),
    ("cdla-permissive", 3, 0.9, "community data license agreement", "community data license agreement permissive(?: version)? [12] 0"),
    ("cdla-sharing", 3, 0.9, "community data license agreement", "community data license agreement sharing(?: version)? 1 0"),
    ("ogl-uk-3.0", 3, 0.9, "open government licen", "open government licen[cs]e v(?:ersion)? ?3 0"),
    ("ogl", 2, 0.8, "open government licen", "open government licen[cs]e"),
    ("etalab-2.0", 3, 0.9, "licence ouverte", "licence ouverte(?: open licence)?(?: version)? 2 0"),
    ("dl-de-by-2.0", 3, 0.9, "datenlizenz deutschland", "datenlizenz deutschland(?: –)? namensnennung(?: –)? version 2 0"),
    ("fal-1.3", 3, 0.9, "licence art libre", "licence art libre(?: 1 3)?"),
    # --- models and source-available
    ("openrail-m", 3, 0.9, "openrail", "(?:creativeml |bigscience |bigcode )?openrail m(?: licen[cs]e)?"),
    ("openrail", 2, 0.85, "rail licen", "responsible ai licen[cs]es?|open rail licen[cs]e"),
    ("bsl-1.1", 3, 0.95, "business source licen", "business source licen[cs]e(?: version)? 1 1"),
    ("sspl-1.0", 3, 0.95, "server side public licen", "server side public licen[cs]e(?: version 1)?"),
    ("elastic-2.0", 3, 0.95, "elastic licen", "elastic licen[cs]e (?:v|version )?2(?: 0)?"),
    ("commons-clause", 3, 0.95, "commons clause", "commons clause licen[cs]e condition"),
    ("confluent", 3, 0.9, "confluent community licen", "confluent community licen[cs]e"),
    ("timescale", 3, 0.9, "timescale licen", "timescale licen[cs]e"),
    ("polyform-noncommercial", 3, 0.95, "polyform noncommercial licen", "polyform noncommercial licen[cs]e"),
    ("polyform-shield", 3, 0.95, "polyform shield licen", "polyform shield licen[cs]e"),
    ("prosperity", 3, 0.9, "prosperity public licen", "prosperity public licen[cs]e"),
    ("parity", 3, 0.9, "parity public licen", "parity public licen[cs]e"),
    ("fsl-1.1", 3, 0.9, "functional source licen", "functional source licen[cs]e"),
    ("research-only", 2, 0.7, "research purposes only", "(?:for )?(?:non ?commercial )?research purposes only"),
    ("evaluation-only", 2, 0.7, "evaluation purposes only", "for evaluation purposes only"),
    # --- proprietary and notices
    ("proprietary", 2, 0.7, "unauthorized copying of this file", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 2, 0.7, "without the express", "(?:reproduction|distribution|copying)(?: [^ ]+){0,6} (?:is )?(?:strictly )?prohibited without the express (?:written )?permission"),
    ("proprietary", 2, 0.65, "no part of this publication", "no part of this publication may be reproduced"),
    ("proprietary", 2, 0.65, "licensed not sold", "(?:software|product|content) is licensed not sold"),
    ("eula", 2, 0.7, "end user licen", "end user licen[cs]e agreement"),
    ("trade-secret", 1, 0.5, "trade secret", "trade secrets? of (?!the)[^ ]+"),
    ("warranty-disclaimer", 1, 0.3, "as is without warranty", "(?:software|work|material) is provided as is without warranty of any kind"),
    ("patent-grant", 1, 0.4, "patent licen", "grants? (?:to )?you a (?:[^ ]+ ){0,8}patent licen[cs]e"),
    ("see-license-file", 1, 0.3, "licen", "see (?:the )?(?:file )?(?:license|licence|copying)(?: txt| md)? (?:file )?for (?:the )?(?:details|license|terms|more information)"),
    ("dual-license", 1, 0.4, "dual licen", "dual licen[cs]ed under"),
    ("license-notice", 1, 0.3, "licen", "this (?:file|work|document|project|package|library|software|dataset) is (?:dual )?licen[cs]ed under"),
]

#: what every keyword above holds at least one of, and hardly any other text does
STRONG = ("licen", "permission", "redistributions", "copyright", "publicdomain", "public domain", "copies or substantial", "to deal in the software",
          "x consortium", "usage of the works", "curl", "endorse or promote", "advertising materials", "berkeley", "unless required by", "apache software",
          "llvm exception", "gnu ", "either version", "gpl", "implied warranty", "classpath exception", "special exception", "font exception",
          "gcc runtime", "mozilla", "eclipse", "common development", "nasa open", "mulan psl", "misrepresented", "altered source", "unencumbered",
          "wtfpl", "buy me a beer", "written agreement", "openssl", "perl itself", "jpeg group", "reserved font", "cc0", "creative commons",
          "creativecommons", "datenlizenz", "openrail", "commons clause", "purposes only", "unauthorized copying", "without the express",
          "no part of this", "trade secret", "as is without", "bsd 2", "bsd 3", "modern variant", "mit no attribution", "boost")
