"""Public licence notices that the paragraph classifier is trained on: data only.

``NOTICES`` has the families it tells apart, ``OTHERS`` licences and sentences that share
their words and belong to none of these families.
"""

from __future__ import annotations

_DISCLAIMER = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)

# Fixed texts: usual short notices and the paragraphs of the licences, by family, in lower case and without punctuation.
NOTICES = {
    "agpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "licensed under the gnu affero general public license version 3",
        "gnu affero general public license v3 or later",
        "available under the agpl version 3",
    ],
    "apache": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "distributed under the apache 2.0 license",
        "apache software license 2.0",
        "available under the terms of apache 2.0",
        "spdx license identifier apache 2.0",
        "apache license version 2.0 january 2004 terms and conditions for use reproduction and distribution",
        "licensed to the apache software foundation asf under one or more contributor license agreements see the notice file distributed with this work for additional information regarding copyright ownership",
    ],
    "artistic": [
        "this program is free software you can redistribute it and or modify it under the terms of the artistic license",
        "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package",
        "released under the artistic license 2.0",
    ],
    "boost": [
        "distributed under the boost software license version 1.0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt",
        "boost software license version 1.0 august 17th 2003",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
        "released under the bsd license",
        "bsd 3 clause license",
        "bsd 2 clause simplified license",
        "use of this source code is governed by a bsd style license that can be found in the license file",
        "spdx license identifier bsd 3 clause",
    ],
    "cc-by": [
        "licensed under cc by 4.0",
        "creative commons attribution 4.0 international license",
        "this work is licensed under a creative commons attribution 3.0 unported license",
        "to view a copy of this license visit http creativecommons org licenses by 4.0",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4.0",
        "creative commons attribution noncommercial 4.0 international license",
        "this work is licensed under a creative commons attribution non commercial 3.0 unported license",
        "to view a copy of this license visit http creativecommons org licenses by nc 4.0",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4.0",
        "creative commons attribution sharealike 4.0 international license",
        "this work is licensed under a creative commons attribution share alike 3.0 unported license",
        "to view a copy of this license visit http creativecommons org licenses by sa 4.0",
    ],
    "cc0": [
        "dedicated to the public domain under cc0 1.0",
        "no rights reserved public domain dedication cc0",
        "released under cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1.0 universal",
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ],
    "gfdl": [
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1.3 or any later version published by the free software foundation with no invariant sections no front cover texts and no back cover texts",
        "a copy of the license is included in the section entitled gnu free documentation license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
        "licensed under the gpl version 2 or later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2",
        "released under gpl version 3",
        "spdx license identifier gpl 2.0 or later",
        "licensed under the terms of the gnu gpl version 3",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages",
        "released under the isc license",
        "isc license isc",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2.1",
        "released under the lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "licensed under the lgpl version 3 or later",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        _DISCLAIMER,
        "the mit license mit",
        "mit licensed",
        "spdx license identifier mit",
        "distributed under the terms of the mit license",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0",
        "licensed under the mozilla public license 2.0",
        "the contents of this file are subject to the mozilla public license version 1.1 the license you may not use this file except in compliance with the license",
        "released under the mpl 2.0",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "released under the unlicense",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "released under the zlib license",
        "zlib libpng license",
    ],
}

OTHERS = [
    "he lost his driving license and could not drive",
    "a fishing licence is sold at the public office",
    "the pilot was licensed by the general staff",
    "poetic license is granted to the writer",
    "copyright law is taught in the second year",
    "all rights reserved by the hotel for the rooms",
    "all rights reserved",
    "permission to enter was granted by the mayor",
    "the warranty of the car covers two years and is limited to the engine",
    "students at mit wrote the paper",
    "the mit press published the book in 2004",
    "an apache helicopter landed near the village",
    "the apache web server answers on port 80",
    "the general public may visit on sunday",
    "version 3 of the report is due",
    "version 2.0 of the program was released in may",
    "the gnu is a large animal of the plains",
    "the creative team met in the commons",
    "the domain of the function is public",
    "the building is in the public domain of the city",
    "a software company opened an office",
    "copyright the authors",
    "copyright 2020 the authors all rights reserved",
    "licensed premises are open until two",
    "the license plate of the car was new",
    "the terms of the contract were modified",
    "the contract shall be governed by the law of the state and any claim shall be brought before its courts",
    "in no event shall the hotel be liable for loss of valuables left in the rooms",
    "the fee for a copy of the document is two euros",
    "free of charge for children under six",
    "the source of the river is in the hills and its form is a wide arc",
    "you can redistribute the leaflets and modify the text as you like",
    "the software was distributed on tapes without a manual",
    "the mozilla browser was first published in 1998",
    "boost your energy with this drink",
    "the artistic director left the theatre after the second year",
    "the library is free and open to the public on weekdays",
    "see the file for more details",
    "the conditions for the use of the pool are posted at the door",
    "this document may not be copied in whole or in part without the prior written permission of the publisher",
    "the contents of this file are subject to the terms of the common development and distribution license you may not use this file except in compliance with the license",
    "this font software is licensed under the sil open font license version 1.1",
    "the python software foundation license version 2 applies to this work",
    "licensed under the european union public licence eupl version 1.2",
    "this software is proprietary and confidential unauthorized copying of this file is strictly prohibited",
    "the license agreement between you and the company covers the use of the product",
    "your license to use the service ends when the account is closed",
]

#: How a licence is usually named, by family, and the usual short sentences around its name.
NAMES = {
    "agpl": ["agpl version 3", "gnu agpl", "affero gpl", "gnu affero general public license"],
    "apache": ["apache 2.0", "apache license", "apache license version 2.0"],
    "artistic": ["artistic license", "perl artistic license", "artistic 2.0"],
    "boost": ["boost software license", "boost license 1.0"],
    "bsd": ["bsd", "bsd 2 clause", "bsd 3 clause", "new bsd license"],
    "cc-by": ["cc by", "cc by 4.0", "creative commons attribution"],
    "cc-by-nc": ["cc by nc", "cc by nc 4.0", "creative commons attribution noncommercial"],
    "cc-by-sa": ["cc by sa", "cc by sa 4.0", "creative commons attribution sharealike"],
    "cc0": ["cc0", "cc0 1.0", "creative commons zero"],
    "gfdl": ["gnu free documentation license", "gfdl"],
    "gpl": ["gpl version 2", "gpl version 3", "gpl v2", "gnu gpl", "gnu general public license"],
    "isc": ["isc", "isc license"],
    "lgpl": ["lgpl version 2.1", "lgpl version 3", "gnu lgpl", "gnu lesser general public license"],
    "mit": ["mit", "mit license", "expat license"],
    "mpl": ["mpl 2.0", "mozilla public license", "mozilla public license version 2.0"],
    "unlicense": ["unlicense", "the unlicense", "unlicense org"],
    "zlib": ["zlib license", "zlib libpng"],
}
SENTENCES = ["{} license", "license {}", "{} licensed", "licensed under {}", "licensed under the {}", "this code is {}", "released under the terms of the {}", "the data is available under {}",
             "under {} terms", "{} applies", "uses {}", "licence {}", "covered by {}", "{} only", "terms {}", "subject to {}"]

# Words that tell nothing alone.
STOP = (
    "a all an and any are as at be been but by can do for from has have he her his if in into is it its may must no nor not of on one or other out over "
    "see shall should so some such than that the their them then there these they this to use used was were which who will with without work you your"
).split()
