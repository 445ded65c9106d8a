"""What the licence classifier learns from: statements of each family and ordinary prose, in groups that are held out whole."""

from __future__ import annotations

#: fixed values: openings and notices of public licences. The last statement of each family is held out for calibration, the others train; all are templates
STATEMENTS = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "apache license version 2.0 january 2004 terms and conditions for use reproduction and distribution",
    ],
    "mit": [
        "released under the mit license",
        "the mit license copyright permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "distributed under the mit license",
        "this project is licensed under the terms of the mit license",
    ],
    "isc": [
        "released under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "available under the isc license",
        "licensed under the isc license",
    ],
    "bsd-2-clause": [
        "released under the 2 clause bsd license",
        "the simplified bsd license redistribution and use in source and binary forms with or without modification are permitted provided that the following two conditions are met",
        "distributed under the bsd 2 clause license",
        "licensed under the bsd 2 clause license",
    ],
    "bsd-3-clause": [
        "released under the 3 clause bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "distributed under the bsd 3 clause license",
        "licensed under the new bsd 3 clause license",
    ],
    "gpl-2.0": [
        "licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
        "covered by the gpl version 2",
        "licensed under the gnu gpl v2",
        "released under the gnu gpl version 2",
    ],
    "gpl-3.0": [
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
        "covered by the gpl version 3",
        "licensed under the gnu gpl v3",
        "released under the gnu gpl version 3",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "covered by the lgpl version 2.1 or later",
        "distributed under the gnu lgpl version 3",
        "released under the gnu lgpl",
    ],
    "agpl-3.0": [
        "licensed under the gnu affero general public license version 3",
        "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license",
        "covered by the agpl version 3 or later",
        "distributed under the gnu agpl v3",
        "released under the gnu agpl version 3",
    ],
    "mpl-2.0": [
        "licensed under the mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
        "covered by the mpl version 2.0",
        "distributed under the mpl 2.0",
        "released under the mpl 2.0",
    ],
    "epl-2.0": [
        "licensed under the eclipse public license version 2.0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at http www eclipse org legal epl 2.0",
        "covered by the epl version 2.0",
        "distributed under the epl 2.0",
        "released under the epl 2.0",
    ],
    "unlicense": [
        "released under the unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        "licensed under the unlicense",
    ],
    "cc0": [
        "dedicated to the public domain under cc0 1.0 universal",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work under cc0",
        "the data are available under cc0",
        "licensed under cc0 1.0",
    ],
    "cc-by-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "released under the cc by 4.0 license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "released under the cc by sa 4.0 license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "released under the cc by nc 4.0 license"],
    "cc-by-nd-4.0": ["licensed under cc by nd 4.0", "this work is licensed under a creative commons attribution noderivatives 4.0 international license", "released under the cc by nd 4.0 license"],
    "cc-by-nc-sa-4.0": ["licensed under cc by nc sa 4.0", "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license", "released under the cc by nc sa 4.0 license"],
    "all-rights-reserved": ["all rights reserved", "copyright all rights reserved no part of this publication may be reproduced without prior permission of the publisher", "the authors all rights reserved"],
}
#: fixed values: licences that no family stands for; the first half trains the unknown class, the second half measures its error
OTHER_LICENCES = """licensed under the artistic license 2.0|released under the zlib license|released under the terms of the vendor|released under the old rules|distributed under the rules of the club|covered by the insurance of the firm|this software is provided as is under the boost software license version 1.0|licensed under the european union public licence version 1.2
this font software is licensed under the sil open font license version 1.1|use is subject to the end user license agreement of the vendor|the driver holds a valid license for this vehicle class
licensed under the microsoft public license|released under the postgresql license|distributed under the terms of the python software foundation license|licensed under the open data commons database license
available under the wtfpl|the evaluation license ends after thirty days""".replace("\n", "|").split("|")
#: ordinary prose, near misses among it
PROSE = """the license of the driver was renewed|all rights and duties of the tenant are listed below|she released the album under a new name|the general public was not told|the public license plate was lost
version 2.0 of the game is out|permission to enter was granted to the visitors|this work is hard and the pay is low|the software crashed again|the foundation published a report|reserved and quiet people
copyright law is a field of study|the file was copied|the creative team met the common people|a mozilla developer spoke in public|the domain of the function is the set of reals|rights of way
the seats are reserved for members|all that was on the table|in the name of the law|das ist nicht die frage|la vie est belle et les jours sont longs|el libro de la casa no es mío|licensed to drive|trade fell by 4.0 points|wages rose by 3.5 percent
the terms of the sale were changed|free of charge parking for any person|under the bridge|international trade grew by 4.0 percent|the university of massachusetts|an apache helicopter flew by
it was the best of times|they and the others came from afar|source and binary stars|the authors thank the editor|non commercial flights were cancelled|by 2020 nothing had changed|she was granted a license
th an er in on re he ti|und der die mit von im zu|que de la el en los ción ado|le les des et un une ment tion|see the file for details|you may obtain a copy at the desk|the copyright holder spoke
the work of the author is free|modify the plan and distribute the tasks|no warranty was given for the car|the eclipse was visible at noon|attribution of the painting is unclear|a new general took command
the commons voted on the bill|he waived his rights to the estate|redistribution of income|the conditions are met in most cases|public domain names are registered|the clause was struck from the contract""".replace("\n", "|").split("|")
#: what stands before and after statements
LEADS = ("", "this work is ", "this file is ", "the software is ", "unless stated otherwise the text is ", "copyright 2021 the authors ", "note ", "see license file ", "content ")
TAILS = ("", " see the file for details", " by the authors", " some more words follow here", " 2020", " in all countries")
