"""Public wordings of licence notices, grants and clauses, and sentences that sound like them and are none."""

from __future__ import annotations

# Paragraphs by family, in the words of the licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Released under MIT.",
        "This project is licensed under the MIT License. See the LICENSE file for details.",
        "Licensed under the MIT license.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        "https://opensource.org/licenses/MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 licence.",
        "Distributed under Apache-2.0, see the NOTICE file.",
        "SPDX-License-Identifier: Apache-2.0",
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS "
        "IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        "\"Derivative Works\" shall mean any work, whether in Source or Object form, that is based on (or derived from) the Work and for "
        "which the editorial revisions, annotations, elaborations, or other modifications represent, as a whole, an original work of "
        "authorship.",
        "\"Contribution\" shall mean any work of authorship, including the original version of the Work and any modifications or additions "
        "to that Work or Derivative Works thereof, that is intentionally submitted to Licensor for inclusion in the Work by the copyright "
        "owner.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a "
        "perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative "
        "Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object "
        "form.",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, "
        "worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have "
        "made, use, offer to sell, sell, import, and otherwise transfer the Work.",
        "If the Work includes a \"NOTICE\" text file as part of its distribution, then any Derivative Works that You distribute must "
        "include a readable copy of the attribution notices contained within such NOTICE file.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Distributed under BSD-3-Clause.",
        "Released under the 2-clause BSD licence.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT.",
        "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product "
        "includes software developed by the University.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL version 2 or later.",
        "Licensed under GPLv2 or later.",
        "GPLv2 or later",
        "GPLv3+",
        "This plugin is GPLv3 licensed.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
        "To \"convey\" a work means any kind of propagation that enables other parties to make or receive copies. Mere interaction with a "
        "user through a computer network, with no transfer of a copy, is not conveying.",
        "You may convey a work based on the Program, or the modifications to produce it from the Program, in the form of source code under "
        "the terms of section 4, provided that you also meet all of these conditions:",
        "The \"Corresponding Source\" for a work in object code form means all the source code needed to generate, install, and (for an "
        "executable work) run the object code and to modify the work, including scripts to control those activities.",
        "You may not impose any further restrictions on the exercise of the rights granted or affirmed under this License. For example, "
        "you may not impose a license fee, royalty, or other charge for exercise of rights granted under this License.",
        "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you "
        "conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty.",
        "You must cause any work that you distribute or publish, that in whole or in part contains or is derived from the Program or any "
        "part thereof, to be licensed as a whole at no charge to all third parties under the terms of this License.",
        "If you develop a new program, and you want it to be of the greatest possible use to the public, the best way to achieve this is "
        "to make it free software which everyone can redistribute and change under these terms.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Available under LGPLv3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "A program that contains no derivative of any portion of the Library, but is designed to work with the Library by being compiled or "
        "linked with it, is called a \"work that uses the Library\".",
        "You may convey a Combined Work under terms of your choice that, taken together, effectively do not restrict modification of the "
        "portions of the Library contained in the Combined Work and reverse engineering for debugging such modifications.",
        "This license, the GNU Library General Public License, applies to some specially designated libraries.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This service is released under AGPLv3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all "
        "users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version.",
    ],
    "GFDL": [
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, "
        "Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, "
        "and no Back-Cover Texts.",
        "Licensed under the GNU FDL 1.2.",
        "SPDX-License-Identifier: GFDL-1.3-or-later",
        "The \"Invariant Sections\" are certain Secondary Sections whose titles are designated, as being those of Invariant Sections, in the "
        "notice that says that the Document is released under this License.",
        "You may copy and distribute a Modified Version of the Document under the conditions of sections 2 and 3 above, provided that you "
        "release the Modified Version under precisely this License.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "Distributed under MPL 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
        "Software distributed under the License is distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, either express or "
        "implied. See the License for the specific language governing rights and limitations under the License. The Original Code is",
        "\"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable "
        "Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof.",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, "
        "must be under the terms of this License.",
        "The Initial Developer hereby grants You a world-wide, royalty-free, non-exclusive license, subject to third party intellectual "
        "property claims, under intellectual property rights licensable by Initial Developer, to use, reproduce and modify the Original "
        "Code.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 1.0.",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "v1.0 which accompanies this distribution.",
        "SPDX-License-Identifier: EPL-2.0",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR "
        "DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "CDDL": [
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may "
        "not use this file except in compliance with the License.",
        "Licensed under the Common Development and Distribution License 1.0.",
        "SPDX-License-Identifier: CDDL-1.0",
        "When distributing Covered Code, include this CDDL HEADER in each file and include the License file at "
        "usr/src/OPENSOLARIS.LICENSE. If applicable, add the following below this CDDL HEADER.",
    ],
    "EUPL": [
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the "
        "EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.",
        "Licensed under the European Union Public Licence, version 1.2.",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "Artistic": [
        "Licensed under the Artistic License 2.0.",
        "This library is free software; you may redistribute it and/or modify it under the same terms as Perl itself.",
        "SPDX-License-Identifier: Artistic-2.0",
        "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder "
        "maintains some semblance of artistic control over the development of the package, while giving the users of the package the "
        "right to use and distribute the Package in a more-or-less customary fashion.",
        "You may otherwise modify your copy of this Package in any way, provided that you insert a prominent notice in each changed file "
        "stating how and when you changed that file, and provided that you do at least ONE of the following:",
    ],
    "PSF": [
        "Licensed under the Python Software Foundation License, version 2.",
        "SPDX-License-Identifier: PSF-2.0",
        "This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") "
        "accessing and otherwise using this software (\"Python\") in source or binary form and its associated documentation.",
        "PSF is making Python available to Licensee on an \"AS IS\" basis. PSF MAKES NO REPRESENTATIONS OR WARRANTIES, EXPRESS OR IMPLIED.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "ISC licence, see the file COPYING.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.",
    ],
    "Zlib": [
        "Licensed under the zlib License.",
        "SPDX-License-Identifier: Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "This notice may not be removed or altered from any source distribution.",
    ],
    "Boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)",
        "SPDX-License-Identifier: BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
        "Software, and to prepare derivative works of the Software.",
    ],
    "WTFPL": [
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
        "Licensed under the WTFPL.",
        "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, "
        "Version 2, as published by Sam Hocevar.",
        "SPDX-License-Identifier: WTFPL",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as "
        "long as the name is changed.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense, see <https://unlicense.org/>.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain.",
    ],
    "OFL": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
        "Licensed under the SIL OFL 1.1.",
        "The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects, to support the font "
        "creation efforts of academic and linguistic communities.",
        "Neither the Font Software nor any of its individual components, in Original or Modified Versions, may be sold by itself.",
    ],
    "MS-PL": [
        "Licensed under the Microsoft Public License (MS-PL).",
        "SPDX-License-Identifier: MS-PL",
        "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the "
        "license, do not use the software.",
    ],
    "PostgreSQL": [
        "Released under the PostgreSQL License.",
        "SPDX-License-Identifier: PostgreSQL",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a "
        "written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs "
        "appear in all copies.",
    ],
    "NCSA": [
        "Distributed under the University of Illinois Open Source License.",
        "SPDX-License-Identifier: NCSA",
        "This file is distributed under the University of Illinois/NCSA Open Source License. See LICENSE.TXT for details.",
    ],
    "ODbL": [
        "This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/.",
        "Any rights in individual contents of the database are licensed under the Database Contents License.",
        "Contains data of contributors, available under the Open Database License (ODbL).",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted "
        "use, distribution, and reproduction in any medium, provided the original work is properly cited.",
        "https://creativecommons.org/licenses/by/4.0/",
        "see http://creativecommons.org/licenses/by/3.0/ or by/2.5",
        "http://creativecommons.org/licenses/by/3.0/",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "https://creativecommons.org/licenses/by-sa/4.0/",
        "see http://creativecommons.org/licenses/by-sa/3.0/ or by-sa/2.5",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "https://creativecommons.org/licenses/by-nc/4.0/",
        "see http://creativecommons.org/licenses/by-nc/3.0/ or by-nc/2.5",
        "You may not use the material for commercial purposes. Licensed under CC BY-NC-SA 3.0.",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "https://creativecommons.org/licenses/by-nd/4.0/",
        "see http://creativecommons.org/licenses/by-nd/3.0/ or by-nd/2.5",
        "If you remix, transform, or build upon the material, you may not distribute the modified material.",
    ],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "https://creativecommons.org/publicdomain/zero/1.0/",
        "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's "
        "Copyright and Related Rights and associated claims and causes of action in the Work.",
    ],
    "public domain": [
        "This work is in the public domain.",
        "This file has been released into the public domain by its author. This applies worldwide.",
        "As a work of the federal government, this publication is in the public domain and may be copied without permission.",
        "The author disclaims copyright to this source code. In place of a legal notice, here is a blessing:",
    ],
    "proprietary": [
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means "
        "without the prior written permission of the publisher.",
        "Copyright 2021 Example Corporation. All rights reserved.",
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Todos los derechos reservados.",
        "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "This software is the confidential and proprietary information of the company. You shall not disclose such confidential information "
        "and shall use it only in accordance with the terms of the license agreement.",
    ],
}
# Sentences about licences, rights or software that grant nothing.
NEGATIVES = [
    "He lost his driving license on the road to the sea and never asked for another one.",
    "The license fee for the television service rose again this year.",
    "You need a fishing licence to fish in this river, and a permit for the boat.",
    "The poet took some license with the facts of the story.",
    "She was granted permission to leave the meeting early by the chair.",
    "The software was released in spring and sold very well in the first weeks.",
    "The copyright dispute between the two publishers went on for many years in court.",
    "General public transport in the city is free on the first Sunday of each month.",
    "The warranty on the washing machine ran out two days before it broke.",
    "The apache helicopter landed near the base in the morning.",
    "Students at MIT built a robot that can fold shirts.",
    "The new version of the library opens at nine and closes at six.",
    "Under the terms of the agreement, the two companies will share the costs.",
    "The restaurant has a license to serve wine and beer until midnight.",
    "A copy of the letter was found in the box under the stairs.",
    "All the rights of the players were reserved for the next season by the club.",
    "The commons was a creative place where people met to share their work.",
    "It is a matter of public record that the domain was sold last year.",
    "Licensed taxi drivers protested in front of the town hall.",
    "The agency said the licenses were revoked because the conditions were not met.",
    "The foundation gave money to the school, which used it to buy books and tables for the children.",
    "You should see the source of the river, which is distributed over many small lakes in the hills.",
    "The program for the evening included two pieces for piano and one for any number of voices.",
    "This file holds the names of the people who work in the office and the hours at which they come.",
    "Python is a snake, and the word is also used for a programming language that many people like.",
    "The boost in sales came after the company changed the form of its products.",
    "An eclipse of the sun will be seen in the north of the country in the afternoon.",
    "The university has its own rules for the use of the library and of the computers in it.",
    "He claimed that any damages arising from the storm should be paid by the state.",
    "The artistic director of the theatre left after a dispute about the terms of his contract.",
]
# Names and abbreviations of licences, as notices have them.
NAMES = {
    "MIT": ["MIT", "MIT License", "Expat License"],
    "Apache": ["Apache License, Version 2.0", "Apache 2.0", "Apache Software License", "ASL 2.0"],
    "BSD": ["BSD", "BSD 3-Clause", "BSD 2-Clause", "New BSD", "Simplified BSD", "3-clause BSD"],
    "GPL": ["GNU General Public License", "GPL", "GPLv2", "GPLv3", "GNU GPL version 3", "GPL-2.0", "GPL 2"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "LGPL", "LGPLv2.1", "LGPLv3", "GNU LGPL version 3"],
    "AGPL": ["GNU Affero General Public License", "AGPL", "AGPLv3", "GNU AGPL version 3"],
    "GFDL": ["GNU Free Documentation License", "GFDL", "GNU FDL version 1.3"],
    "MPL": ["Mozilla Public License", "MPL 2.0", "MPL", "Mozilla Public License Version 1.1"],
    "EPL": ["Eclipse Public License", "EPL 1.0", "EPL", "Eclipse Public License v2.0"],
    "CDDL": ["Common Development and Distribution License", "CDDL", "CDDL 1.1"],
    "EUPL": ["European Union Public Licence", "EUPL", "EUPL 1.2"],
    "Artistic": ["Artistic License", "Artistic License 2.0", "Perl Artistic License"],
    "PSF": ["Python Software Foundation License", "PSF License", "PSF", "Python license"],
    "ISC": ["ISC", "ISC License"],
    "Zlib": ["zlib License", "zlib", "zlib/libpng License"],
    "Boost": ["Boost Software License", "Boost Software License 1.0", "BSL 1.0", "Boost license"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "OFL": ["SIL Open Font License", "OFL", "OFL 1.1"],
    "MS-PL": ["Microsoft Public License", "MS-PL", "Ms-PL"],
    "PostgreSQL": ["PostgreSQL License", "PostgreSQL"],
    "NCSA": ["University of Illinois/NCSA Open Source License", "NCSA", "NCSA License"],
    "ODbL": ["Open Database License", "ODbL", "ODC Open Database License v1.0"],
    "CC-BY": ["http://creativecommons.org/licenses/by/3.0/", "https://creativecommons.org/licenses/by/2.0", "CC BY 4.0", "CC-BY 3.0", "CC BY", "Creative Commons Attribution License", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-SA": ["http://creativecommons.org/licenses/by-sa/3.0/", "https://creativecommons.org/licenses/by-sa/2.0", "CC BY-SA 4.0", "CC-BY-SA 3.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["http://creativecommons.org/licenses/by-nc/3.0/", "https://creativecommons.org/licenses/by-nc/2.0", "CC BY-NC 4.0", "CC-BY-NC 3.0", "CC BY-NC-SA 4.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial License"],
    "CC-BY-ND": ["http://creativecommons.org/licenses/by-nd/3.0/", "https://creativecommons.org/licenses/by-nd/2.0", "CC BY-ND 4.0", "CC-BY-ND 3.0", "CC BY-ND", "Creative Commons Attribution-NoDerivatives License"],
    "CC0": ["CC0", "CC0 1.0", "Creative Commons Zero"],
}
# How notices name a licence, of whatever family.
FRAMES = [
    "the code is available under the {}", "published under the {}", "{} applies", "License: {}", "under the terms of the {}", "{} licensed",
    "Licensed under {}.", "Licensed under the {} License.", "Released under the {} licence.", "This work is licensed under the {} License, version 2.",
    "SPDX-License-Identifier: LicenseRef-{}", "This software is distributed under the terms of the {} License.",
    "Use of this file is governed by the {} licence agreement.", "See the {} license for the terms of use.", "a license of {}",
    "You may use this work only in accordance with the {} License Agreement.", "Made available under the {} Public License.",
]
# The commonest English words, which any text has many of.
COMMON = "the of and in to is that for it as was with be by on are this from at which or not a an any all you".split()
