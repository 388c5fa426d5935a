"""The built-in URL pattern rules. Fixed values of this engine; a deployment passes its own list.

A pattern is a literal with ``*`` for anything, ``^`` for a separator or the end, ``||`` at the start
for a host or any subdomain of it. Patterns are matched against the lower-cased URL.
"""

#: (pattern, verdict): hosts and places that carry advertising, tracking, accounts, shops, binaries,
#: endless listings, and wording of adult or gambling sites; and places worth an exception.
PATTERNS = [
    ("||ads.", "block"), ("||adserver.", "block"), ("||adservice.", "block"), ("||banner.", "block"), ("||banners.", "block"),
    ("||pixel.", "block"), ("||tracker.", "block"), ("||tracking.", "block"), ("||metrics.", "block"), ("||telemetry.", "block"),
    ("||beacon.", "block"), ("||stats.", "block"), ("||counter.", "block"), ("||click.", "block"), ("||redirect.", "block"),
    ("||login.", "block"), ("||signin.", "block"), ("||accounts.", "block"), ("||checkout.", "block"), ("||cart.", "block"),
    ("||casino.", "block"), ("||poker.", "block"), ("||betting.", "block"), ("||slots.", "block"), ("||porn.", "block"),
    ("||xxx.", "block"), ("||adult.", "block"), ("||escort.", "block"), ("||warez.", "block"), ("||torrent.", "block"),
    ("/ads/", "block"), ("/adserver/", "block"), ("/banners/", "block"), ("/advert/", "block"), ("/sponsored/", "block"),
    ("/track/", "block"), ("/tracking/", "block"), ("/pixel/", "block"), ("/beacon/", "block"), ("/click/", "block"),
    ("/login^", "block"), ("/signin^", "block"), ("/signup^", "block"), ("/register^", "block"), ("/logout^", "block"),
    ("/password/", "block"), ("/account/", "block"), ("/cart^", "block"), ("/checkout^", "block"), ("/basket^", "block"),
    ("/wishlist^", "block"), ("/compare^", "block"), ("/casino/", "block"), ("/poker/", "block"), ("/betting/", "block"),
    ("/porn/", "block"), ("/xxx/", "block"), ("/adult/", "block"), ("/escort/", "block"), ("/warez/", "block"),
    ("/torrent/", "block"), ("/crack/", "block"), ("/keygen/", "block"), ("/serials/", "block"), ("/spam/", "block"),
    ("/cgi-bin/", "block"), ("/wp-admin/", "block"), ("/wp-login.", "block"), ("/xmlrpc.", "block"), ("/phpmyadmin/", "block"),
    ("/calendar/*/day/", "block"), ("/search^*page=", "block"), ("/tag/*/page/", "block"), ("/feed/", "block"), ("/rss/", "block"),
    ("/print/", "block"), ("/share/", "block"), ("/embed/", "block"), ("/popup/", "block"), ("/amp/", "block"),
    (".exe^", "block"), (".msi^", "block"), (".dmg^", "block"), (".apk^", "block"), (".iso^", "block"),
    (".zip^", "block"), (".rar^", "block"), (".tar^", "block"), (".gz^", "block"), (".bin^", "block"),
    (".jpg^", "block"), (".jpeg^", "block"), (".png^", "block"), (".gif^", "block"), (".webp^", "block"),
    (".svg^", "block"), (".ico^", "block"), (".mp3^", "block"), (".mp4^", "block"), (".avi^", "block"),
    (".mov^", "block"), (".css^", "block"), (".js^", "block"), (".woff^", "block"), (".swf^", "block"),
    ("?sessionid=", "block"), ("&sessionid=", "block"), ("?phpsessid=", "block"), ("&phpsessid=", "block"), ("?jsessionid=", "block"),
    ("?replytocom=", "block"), ("&replytocom=", "block"), ("?action=edit^", "block"), ("&action=edit^", "block"), ("?share=", "block"),
    ("?add-to-cart=", "block"), ("&add-to-cart=", "block"), ("?utm_source=", "block"), ("&utm_source=", "block"), ("?sort=*page=", "block"),
    ("/docs/", "allow"), ("/wiki/", "allow"), ("/article/", "allow"), ("/articles/", "allow"), ("/paper/", "allow"),
    ("/abstract/", "allow"), ("/tutorial/", "allow"), ("/manual/", "allow"), ("/reference/", "allow"), ("/blog/", "allow"),
    ("||docs.", "allow"), ("||wiki.", "allow"), ("||developer.", "allow"), ("||library.", "allow"), ("||archive.", "allow"),
]
