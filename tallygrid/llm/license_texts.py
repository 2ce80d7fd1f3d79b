"""Wordings of public licenses and of the notices that files carry, with template markup.

`<<optional>> ... <<end>>` may be left out, `<<any:N>>` stands for up to N words of any kind (names, years, titles).
Only words count: letters and digits in lower case, everything else parts them.
"""

PERMISSIVE_END = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the <<any:6>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
BSD_END = (
    "this software is provided by <<any:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<any:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
BSD_START = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_NAMES = "<<optional>>3<<end>> neither the name of <<any:10>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
#: (label, template)
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software " + PERMISSIVE_END,
    ),
    ("mit", "<<optional>>released<<end>> under the <<optional>>terms of the<<end>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (
        "isc",
        "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<any:6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    ("bsd-3-clause", f"{BSD_START} {BSD_NAMES} {BSD_END}"),
    ("bsd-2-clause", f"{BSD_START} {BSD_END}"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<optional>>http<<end>> <<optional>>https<<end>> www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("apache", "licensed under the apache license <<optional>>version <<any:2>><<end>>"),
    ("apache", "apache license version <<any:2>> <<optional>>january 2004<<end>>"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<any:2>> of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    ("gpl", "licensed under the <<optional>>gnu<<end>> general public license <<optional>>version <<any:2>><<end>>"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu <<optional>>lesser<<end>> general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("cc-by-nc", "<<optional>>licensed under<<end>> cc by nc <<optional>>sa<<end>> <<any:2>>"),
    ("cc-by-sa", "<<optional>>licensed under<<end>> cc by sa <<any:2>>"),
    ("cc-by", "licensed under <<optional>>a<<end>> creative commons attribution <<any:3>> license"),
    ("copyright", "copyright <<optional>>c<<end>> <<any:8>> all rights reserved"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<optional>>http<<end>> <<optional>>https<<end>> mozilla org mpl 2 0"),
    ("mpl", "subject to the terms of the mozilla public license"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    ("public-domain", "released into the public domain"),
)
