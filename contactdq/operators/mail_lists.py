"""Fixed values of the e-mail operators; every list is only a default and can be replaced by a loaded one."""

from __future__ import annotations

VALID_DOMAINS = (
    "gmail.com", "hotmail.com", "hotmail.com.ar", "yahoo.com", "yahoo.com.ar", "outlook.com", "outlook.com.ar", "icloud.com", "live.com", "live.com.ar",
    "fibertel.com.ar", "arnet.com.ar", "speedy.com.ar", "ypf.com", "mercadolibre.com", "aerolineas.com.ar", "techint.com", "ternium.com", "tenaris.com",
    "protonmail.com", "me.com", "msn.com", "claro.com.ar", "personal.com.ar", "movistar.com.ar", "telecentro.com.ar", "adinet.com.uy", "vera.com.uy",
    "pili.com.uy", "cousa.com", "olminco.com", "siet.com.uy", "alontur.com.uy", "estancialosmolles.uy", "waveautomotores.com.uy", "grupodeleon.com.uy",
    "viseport.com.uy", "trali.com.uy", "lipin.com.uy", "mail.com", "email.com", "cloud.com", "prontometal.com",
)

GLOBAL_PROVIDERS = (
    "gmail.com", "hotmail.com", "hotmail.com.ar", "yahoo.com", "yahoo.com.ar", "outlook.com", "outlook.com.ar", "icloud.com", "live.com", "live.com.ar",
    "protonmail.com", "me.com", "msn.com",
)

OWN_COUNTRIES = (
    "ar", "uy", "br", "cl", "co", "pe", "ve", "ec", "bo", "py", "gy", "sr", "mx", "gt", "bz", "hn", "sv", "ni", "cr", "pa", "cu", "do", "ht", "jm", "bs",
    "tt", "bb", "pr", "us", "ca",
)

INVALID_DOMAINS = (
    "02gmail.com", "1.com", "156109208.com", "29yahoo.com", "43gmail.com", "4hotmail.com", "aaa.aaa", "asd.asd", "com.ar", "com.com", "di.com", "dominio invalido", "e-mail.com.ar", "anse.com", "anse.gob.ar", "aoutlook.com", "noposee.com", "notiene.com", "sinmail.com", "sincorreo.com", "nomail.com",
    "test.com", "ejemplo.com", "xxx.com", "noemail.com", "sin.mail", "no.tiene",
)

FINAL_TLDS = (
    "ad", "ae", "ar", "at", "au", "be", "bo", "br", "ca", "cl", "co", "com", "cr", "de", "ec", "es", "fr", "gt", "hn", "info", "io", "it", "jobs", "jp",
    "me", "mx", "net", "ni", "nl", "nz", "org", "pa", "pe", "pt", "py", "ru", "sv", "uk", "us", "uy", "ve", "za", "coop", "edu", "gov", "mil", "biz",
    "pro", "cat", "global", "in", "cn", "se", "sr", "ch", "no", "dk", "fi", "pl", "gr", "tr", "il", "sg", "hk", "tw", "kr", "gb", "ie", "lu", "hu", "cz",
    "ro", "th", "vn", "id", "ph", "my", "sa", "ng", "ke",
)

MIDDLE_TLDS = (
    "biz", "cat", "com", "edu", "gob", "gov", "gub", "mil", "net", "org", "pro", "co",
)

INVALID_USERS = (
    "no+tiene", "posee", "tiene", "notie", "notiene", "no.tiene.correo", "noposee", "ntiene", "sinmail", "sincorreo", "nomail", "elnotien", "elnotiene",
    "no_oposee", "nolotiene",
)

TLD_TYPOS = {
    "con": "com", "cpm": "com", "ocm": "com", "comm": "com", "cim": "com", "vom": "com", "xom": "com", "c0m": "com", "coj": "com", "comn": "com", "cmo":
    "com", "ner": "net", "nte": "net", "ogr": "org", "orgg": "org",
}

NO_MAIL = (
    "notiene", "ntiene", "notienen", "notienecorreo", "notienemail", "noposee", "noposeecorreo", "noposeemail", "sinmail", "sincorreo",
    "sincorreoelectronico", "nomail", "nousa", "norecuerda", "noregistra", "nocorresponde", "notienedireccion",
)

INSTITUTIONS = (
    "afip", "bna", "anses", "arca", "bpba", "jus.mendoza.gov.ar",
)

DOMAIN_TYPOS = {
    "gamail.com": "gmail.com", "gamil.com": "gmail.com", "gamil.com.ar": "gmail.com.ar", "gemail.com": "gmail.com", "gimail.com": "gmail.com", "gmai.com":
    "gmail.com", "gmail.con": "gmail.com", "gmail.comm": "gmail.com", "gmial.com": "gmail.com", "gmil.com": "gmail.com", "gmal.com": "gmail.com",
    "gmaill.com": "gmail.com", "gmaol.com": "gmail.com", "gmaul.com": "gmail.com", "gmeil.com": "gmail.com", "gmiail.com": "gmail.com", "gmmail.com":
    "gmail.com", "gnail.com": "gmail.com", "gmail.cpm": "gmail.com", "gmail.ocm": "gmail.com", "gmai.com.ar": "gmail.com.ar", "hitmail.com":
    "hotmail.com", "homail.com": "hotmail.com", "homtial.com": "hotmail.com", "hotmai.com": "hotmail.com", "hotmaiil.com": "hotmail.com", "hotmial.com":
    "hotmail.com", "hotmail.con": "hotmail.com", "hotmail.con.ar": "hotmail.com.ar", "htmail.com": "hotmail.com", "otmail.com": "hotmail.com",
    "hotmaill.com": "hotmail.com", "hotmaul.com": "hotmail.com", "hotmeil.com": "hotmail.com", "hotmial.com.ar": "hotmail.com.ar", "hotmail.cpm":
    "hotmail.com", "hotmail.ocm": "hotmail.com", "hotnail.com": "hotmail.com", "htomail.com": "hotmail.com", "hotimail.com": "hotmail.com", "hayoo.com":
    "yahoo.com", "hayoo.com.ar": "yahoo.com.ar", "yahho.com": "yahoo.com", "yaho.com": "yahoo.com", "yahoo.com.art": "yahoo.com.ar", "yahoo.con":
    "yahoo.com", "yhoo.com": "yahoo.com", "yahooo.com": "yahoo.com", "yhaoo.com": "yahoo.com", "yaoo.com": "yahoo.com", "yahoo.cpm": "yahoo.com",
    "yahooo.com.ar": "yahoo.com.ar", "outloook.com": "outlook.com", "outlok.com": "outlook.com", "outook.com": "outlook.com", "outlook.con":
    "outlook.com", "outlookk.com": "outlook.com", "outlouk.com": "outlook.com", "otlook.com": "outlook.com", "iclod.com": "icloud.com", "iclou.com":
    "icloud.com", "icloud.con": "icloud.com", "iclould.com": "icloud.com", "speedy.con.ar": "speedy.com.ar", "live.con.ar": "live.com.ar", "adinet.com":
    "adinet.com.uy", "ainet.com": "adinet.com.uy", "adinet.uy": "adinet.com.uy", "adienet.com.uy": "adinet.com.uy", "adinel.com.uy": "adinet.com.uy",
    "adnet.com.uy": "adinet.com.uy", "adient.com.uy": "adinet.com.uy", "dinet.com.uy": "adinet.com.uy", "ainet.com.uy": "adinet.com.uy", "vera.com":
    "vera.com.uy", "vera.cpm.uy": "vera.com.uy", "vera.co.uy": "vera.com.uy", "hotmail.co": "hotmail.com", "yahoo.co": "yahoo.com", "outlook.co":
    "outlook.com", "live.co": "live.com", "gmail.co": "gmail.com", "icloud.co": "icloud.com", "gmail.com.ar": "gmail.com", "gmail.con.ar": "gmail.com",
    "gmail.co.ar": "gmail.com", "gmail.es": "gmail.com", "gmail.ar": "gmail.com", "gmail.cm": "gmail.com", "gmail.om": "gmail.com", "gmail.comn":
    "gmail.com", "gmail.comh": "gmail.com", "gmail.com.com": "gmail.com", "gmail.com.mx": "gmail.com", "gmail.com.ae": "gmail.com", "gmail.com.se":
    "gmail.com", "hotmail.ar": "hotmail.com.ar", "hotmail.com.com": "hotmail.com", "hotmail.ccom": "hotmail.com", "hotmail.comj": "hotmail.com",
    "hotmail.om": "hotmail.com", "hotmail.cl": "hotmail.com.cl", "yahoo.ar": "yahoo.com.ar", "yahoo.con.ar": "yahoo.com.ar", "yahoo.como.ar":
    "yahoo.com.ar", "yahoo.br": "yahoo.com.br", "yahoo.ca": "yahoo.com.ca", "outlook.ar": "outlook.com.ar", "outlook.cl": "outlook.com.cl", "live.cl":
    "live.com.cl", "live.ca": "live.com.ca",
}
