"""Licence notices by family, and paragraphs that are none: what license_scan learns from.

Fixed values: the families' names, and the notices' usual wording.
"""

TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the license file in the project root for full license information.",
        "This project is distributed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This product is released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GNU GPL, version 2 or later.",
        "This library is free software and comes under the GNU Lesser General Public License.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU Affero General Public License version 3.",
    ],
    "bsd": [
        "Licensed under the 3-clause BSD License.",
        "Released under the BSD license.",
        "Use of this source code is governed by a BSD-style license that can be found in the license file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC-SA 4.0, for non-commercial use only.",
        "Shared under the Creative Commons Attribution-NonCommercial-ShareAlike license.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; CC BY-SA 4.0.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "This text is in the public domain.",
    ],
    "isc": [
        "Released under the ISC license.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "zlib": [
        "Licensed under the zlib license.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
    "epl": [
        "Distributed under the Eclipse Public License.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Use, modification and distribution is subject to the Boost Software License, Version 1.0.",
    ],
    "artistic": [
        "Licensed under the Artistic License, version 2.",
        "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
    ],
    "ofl": [
        "This font software is licensed under the SIL Open Font License, Version 1.1.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the author. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ],
}

#: Licence-like, but of no family above.
UNKNOWN = [
    "Licensed under the terms of our own license.",
    "Released under a custom license, see the license file.",
    "This work is licensed under the terms found in the appendix.",
    "See the license terms before you use this software.",
    "The license of this data set does not permit copies.",
    "Published under an open license, version 1.",
    "Released under the Open Data Commons license.",
    "Licensed to its readers under terms that are stated elsewhere.",
    "You may use this software under the terms of the agreement that you signed.",
    "This file is covered by the license of the company.",
]

OTHER = [
    "He lost his driving license on the way to the public library.",
    "The license plate of the car was found in the river.",
    "All the rights of the people were reserved for the king.",
    "The general came home in version after version of the story.",
    "She studied at the institute and wrote software for a source of free energy.",
    "The public was free to use the garden, and the domain was large.",
    "The foundation of the house was built on a form of clay.",
    "We met in the morning and talked about the weather and the work.",
    "Permission to enter was given to any person who asked.",
    "The creative commons room of the school is open on Monday.",
    "This work is hard, and it is the fourth this year.",
    "The apache people lived in the south west.",
    "A copy of the letter was obtained at the office.",
    "The new edition has four parts and was published in spring.",
    "Conditions were good and the notice was included in all copies of the paper.",
    "Er ging mit ihr in die Stadt, und sie kamen mit dem Zug zurück.",
    "Text and source of the song are found in the library.",
    "Der Führerschein wurde unter dem Tisch gefunden und alle Rechte waren klar.",
    "La ville est libre et le public est dans le jardin de la maison.",
    "El trabajo es de todos los que viven en la ciudad y en el campo.",
    "The version of the program that was released on Friday had an error.",
    "Under the bridge the water was released from the dam.",
    "Der Hund lief mit dem Ball unter der Brücke durch, der mit ihm spielte, und er kam nur mit Mühe zurück.",
    "Sie sprach mit der Frau, die mit dem Kind unter der Decke lag, und mit einem Freund.",
    "Nur mit Geduld ist das zu machen, und nicht mit Gewalt.",
    "Il vivait sous le pont avec les autres, et sous la pluie il chantait.",
    "Bajo la mesa estaba el perro, y bajo el puente la barca.",
    "She was the only one of them who came, and only for an hour.",
    "You may see the project in May, and its file must be on the table of the office.",
    "The code of the door is written in the text of the letter, and the data is open to all.",
    "For this purpose the original distribution of the newspaper was changed, without any limitation.",
    "The author of the publication derived the name from the following story.",
    "The software of the company has a new version, and the products are provided with documentation.",
    "No damages are claimed, and the charge was dropped after the writing was found.",
    "We shared the example with the public, and the style of the font was custom for the subject.",
    "Neither the express train nor the bus should appear before the conditions are right.",
    "They published a copy of the book and distributed it in general stores under a new name.",
    "What the material is subject to, in terms of heat, is shown in part 2 of section 3 on page 104.",
    "Get it free of charge, 10 for 2, until 4.0 or 3.0 litres are gone.",
    "The portions were substantial and the restriction on speed was lifted, provided that it rained.",
    "He received a written warranty and the permission to use the garden as a source of food.",
    "An open house, a house on the commons, a foo fighter and an xyz file are all examples.",
]

#: The names that licences go by, in notices and as identifiers.
NAMES = {
    "mit": ["MIT", "MIT License", "Expat", "X11"],
    "apache": ["Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "ASL 2.0"],
    "gpl": ["GPL-2.0-only", "GPL-3.0-or-later", "LGPL-2.1", "AGPL-3.0", "GNU GPL", "GPLv2", "GPLv3", "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause", "BSD License", "New BSD License"],
    "mpl": ["MPL-2.0", "Mozilla Public License 2.0"],
    "cc-by-nc": ["CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial"],
    "cc-by": ["CC-BY-4.0", "CC BY-SA 4.0", "CC-BY-3.0", "Creative Commons Attribution"],
    "public-domain": ["CC0-1.0", "CC0", "Unlicense"],
    "isc": ["ISC", "ISC License"],
    "zlib": ["Zlib", "zlib/libpng license"],
    "epl": ["EPL-2.0", "EPL-1.0", "Eclipse Public License"],
    "boost": ["BSL-1.0", "Boost Software License"],
    "artistic": ["Artistic-2.0", "Artistic License 2.0"],
    "ofl": ["OFL-1.1", "SIL Open Font License"],
    "unknown": ["Foo", "Foo-1.0", "custom license", "Open Data Commons", "Example Public License", "house license", "XYZ License 2"],
}
#: How names are put into notices: these are learned from ...
WORDINGS = ["SPDX-License-Identifier: {}", "Licensed under {}.", "Released under the {}.", "This project is licensed under the {}", "License: {}", "Distributed under the terms of the {}.", "Lizenziert unter der {}-Lizenz.", "Sous licence {}.", "Publicado bajo la licencia {}."]
#: ... and these set the temperature, and are what the tests judge by.
HELD_WORDINGS = ["Published under the {}.", "This file is available under the {}", "Veröffentlicht unter der {}-Lizenz.", "@license {}", "You can use it under the terms of the {}."]
