"""Generated training texts for the personal-information tagger: letters, notices, minutes and
deliveries in four languages with invented names, numbers and places, and the spans of what is
personal. None of it is taken from a corpus: neither sentences nor names, nor the beginnings and ends
that names are made of, which are drawn anew from syllables for every sample.

A slot in braces is replaced by generated text; slots in upper case are labelled. Half of the
family names are in the lexicon the sample is made with, the others share its beginnings and ends
or nothing, so that the tagger learns to do without the list. A text has two persons of its own, who
recur in it in several forms, now and then misspelt.
"""

from __future__ import annotations

import random
import re

from countweave.llm.pii_text import Lexicon, ahv_valid

GIVEN = "Anna Peter Laura Marco Nina Paul Sarah David Elena Simon Julia Martin Claire Louis Emma Hugo Paolo Sofia Carlo Lucia Ian Rachel Oliver Grace Amir Leila Goran Ivana Jan Mia Tomasz Aiko Yusuf Hans-Ueli Anne-Marie Jean-Luc Maria-Pia Märta Zoé Béat Köbi Jürg Søren".split()
ODD = "Ghezzi Okafor Lindqvist Tran Baumgart Roche Silveira Novak Achermann Perrin Favre Bianchi Whitlock Rossi Meier Smith Weber Costa".split()
PART = ["de", "di", "von", "van", "del", "de la"]
ONSETS, VOWELS, CODAS = "b br d f fl g gr h k kl l m n p pf r s sch st t tr w z".split(), "a e i o u ä ö ü ei au".split(), "l n r s t ck ld lt mp nd rt tz".split()
STREET_TAILS = "strasse weg gasse platz rain quai str. hag".split()
FOREIGN = ["rue de {t}", "rue des {t}", "rue du {t}", "chemin de la {t}", "avenue {t}", "chemin {t}", "route de {t}", "via {t}", "via {t} {t}", "viale {t}", "rue {t} {t}", "piazza {t}", "Via {t}", "Rue de {t}", "corso {t}"]
BARE = ["Unter{t}", "Ober{t}", "Am {T}", "Am {T}hag", "Am {T}rain", "Im {T}hof", "Im {T}", "In der {T}", "{T}", "{T}dorf"]
NOUNS = "Heizung Rechnung Wohnung Lieferung Schlüssel Keller Treppe Bibliothek Sitzung Kasse Garten Dachrinne Versicherung Küche Waschküche Anmeldung Quittung Mappe".split()

# Slots: N full name, T family name after a form of address, A address, E P D items;
# g given name alone, s street, t town, n h c y numbers, date, handle, ref, noun
SIGNED = ["{N}", "{N}\n{A}", "{N}\n{A}\n{tel}{P}\n{mail}{E}", "{N}\n{mail}{E}", "{N}\n{tel}{P}", "{N}\n<{E}>", "{N} | {A}", "{N} | {A} | {tel}{P}", "{N} | {tel}{P} | {mail}{E}", "{A}", "{N} - {tel}{P}", "{N}, {A}", "{N} | {A} | <{E}>"]
BYE = ["Hochachtungsvoll", "Mit besten Wünschen", "Herzlich,", "Bis bald", "Yours sincerely,", "Kind wishes", "See you soon,", "Avec mes respects,", "Bien à vous", "Con ossequi,", "Distinti saluti", "i. A.", "gez.", "***", "~~~", "--"]
PERSONAL = [
    # letters and notices, German
    "Die Wohnung im ersten Stock gehört {N}.", "Den Schlüssel hat {N} beim Abwart hinterlegt.", "Für die Übergabe ist {HF} {T} zuständig.", "{HF} {T} nimmt die Anmeldung bis {date} entgegen.", "{HF} Dr. {N} leitet die Sitzung.", "Protokoll: {N}. Entschuldigt: {N} und {N}.", "Das Paket geht an {N}, {A}.", "Rechnungsadresse: {A}", "Unser Büro ist neu an der {A}.", "Sie finden uns {A}, zweiter Eingang.", "Der Umzug führt von {A} nach {A}.", "Wir wohnen {A} im Parterre.", "Ich arbeite {A}.", "Bin seit Mai {A} daheim.", "Wohnhaft {A} und {A}.", "Bei Fragen gibt {N} unter {P} Auskunft.", "Auskunft: {P} oder {E}.", "Rückmeldungen gern an {E}.", "Ihre Ansprechperson: {N}", "Tierarzt {N} hat am {date} Dienst.", "Erreichbar bin ich unter {P}, vormittags.", "Notfallnummer: {P}", "Pikett {P} rund um die Uhr", "Auskunft {P} - {h} Tage offen", "Die neue Nummer lautet {P}.", "Zuständig ist {N}, Nummer {P}", "Für Notfälle {N}, Tel. {P}", "Abends, {P}.", "Unsere Nummer ist {P}", "Die Nummer des Ausweises ist {D}.", "Sie lautet {D}", "Frag {N}, Tel. {P} Danach schliesst die {noun}.", "Bitte anrufen: {P}!", "Anrufen, {P}!!", "Büro {P} täglich", "Anruf genügt: {P} (nachmittags)", "Der Beleg ({D}) fehlt.", "{P}", "{E}", "{D}", "Schreiben Sie uns: {E}!", "{idl}{D} liegt der Kopie bei.", "Im Formular fehlt noch {idl}{D}.", "Die Nummer {D} steht auf der Rückseite.", "Gesuch von {N}, {idl}{D}.", "Der Vertrag wurde von {N} unterzeichnet.", "Laut {N} war die {noun} abgeschlossen.", "Geburtstag feiern {N} und {N}.", "@{N}: Danke für die {noun}.", "{N} ({E}) bringt Kuchen mit.", "Zeugin war {N}, wohnhaft {A}.", "Kopie an {N}", "Gestern rief {HF} {T} zweimal an.",
    # English
    "The parcel for {N} is still at the desk.", "Please hand the keys to {N} before noon.", "{HM} {T} will chair the meeting.", "{HM} {T} has signed the lease.", "Dr {N} sees patients on weekdays.", "Deliver to: {A}", "We have moved to {A}.", "Our shop at {A} opens early.", "I used to live at {A}.", "I work {A}.", "Text {P} or come by.", "Desk {P} all day", "Office {P} or {P}.", "The ticket says ({D}).", "His ({D}) and hers ({D}) differ.", "Ring {P} when you arrive.", "Phone {P} or mail {E}.", "Questions? {E}", "You can reach {N} on {P}.", "Her number is {P}.", "Ask for {N}, dial {P}.", "I am {N}, ring {P}.", "The desk, {P}, is open.", "Try {P}.", "Their number, {D}, is wrong.", "Write to {E} or {E}", "Mine: {E}", "Our mail is {E}.", "Send the form to {E} please.", "On the form put {idl}{D}.", "His {idl}{D} has expired.", "Minutes taken by {N}.", "Apologies from {N} and {N}.", "According to {N} the {noun} was paid.", "Signed, {N}", "I spoke with {N} on {date}.", "Order for {N}, {E}",
    # French
    "Le bail est au nom de {N}.", "La clé est chez {N}.", "{HM} {T} tient la caisse.", "{HM} {T} vous recevra le {date}.", "Livrer à {N}, {A}.", "Nous habitons {A} depuis peu.", "J'ai emménagé {A}.", "J'occupe {A}", "L'atelier est {A}.", "L'appartement, {A}, est libre.", "D'ici au {A}, dix minutes.", "Notre atelier se trouve {A}.", "Adresse de livraison : {A}", "Pour s'inscrire : {E} ou {P}.", "Joignable au {P} le matin.", "Écrire à {E} avant le {date}.", "Il manque {idl}{D} au dossier.", "Procès-verbal : {N}.", "Selon {N}, la facture est payée.", "Témoin : {N}, {idl}{D}", "Merci d'avertir {N}.",
    # Italian
    "Il contratto è intestato a {N}.", "Le chiavi le tiene {N}.", "Il {HI} {T} apre alle otto.", "La {HI} {T} ha firmato il {date}.", "Consegnare a {N}, {A}.", "Abitiamo in {A} da poco.", "L'ufficio è in {A}.", "Ho casa {A}.", "Sto {A} adesso.", "Il negozio si trova in {A}.", "Indirizzo: {A}", "Per iscriversi: {E} oppure {P}.", "Telefonare al {P} la mattina.", "Scrivere a {E}.", "Manca {idl}{D} nel modulo.", "Verbale: {N}.", "Secondo {N} la fattura è pagata.", "Ringraziamo {N} per la torta.",
]
PLAIN = [
    "Liebe {g}, die {noun} ist da.", "Hallo {g}", "Lieber {g}", "Dear {g},", "Chère {g},", "Cara {g},", "Salü {handle}", "Hey {handle}!", "{handle} hat am {date} geschrieben:", "{handle} schrieb um {time}:", "{handle} wrote on {date}, {time}:", "Message de {handle}, {date} :", "Messaggio di {handle} del {date}:", "[quote={handle}]Das kann ich bestätigen.", "> {g} fragt nach der {noun}.",
    "Der {role} hat die {noun} am {date} genehmigt.", "Der Herr {role} war verhindert.", "Die Frau {role} dankt allen.", "Liebe Frau {role}, wo bleibt die {noun}?", "Herr {role} eröffnet die Versammlung.", "Mr {Erole} opened the session on {date}.", "The {Erole} of the society thanked everyone.", "Mister {Erole}, the {noun} is late.", "Monsieur le {Frole} a ouvert la séance le {date}.", "Madame la {Frole} remercie chacun.", "Il signor {Irole} apre la seduta.", "Signor {Irole}, manca la fattura.", "Ein Kollege der {noun} fehlt heute.",
    "Besammlung {s} {h} Uhr beim Brunnen.", "Besammlung um {h} Uhr an der {s}.", "An der {s} {h} Minuten warten.", "Bei der {s} gilt Tempo {h} seit Mai.", "Von {s} bis {s} sind es {c} Meter.", "Vor der {s} standen {c} Personen um {h} Uhr.", "Die {noun} an der {s} wird im {month} gereinigt.", "Meet in front of {s} at {h} sharp.", "At {s} {h} people queued for {h} minutes.", "The {noun} near {s} closes in {month}.", "Between {s} and {s} the bus is late.", "On se retrouve à {h} h devant la {s}.", "Près de {s}, {c} personnes en {h} minutes.", "Entre {s} et {s} le bus manque.", "Ci troviamo alle {h} presso {s}.", "Vicino a {s} {c} persone in {h} minuti.",
    "Die Messung vom {date} ergab {c} Liter in {h} Tagen.", "Zähler {dev} stand {h} Tage still.", "Meter {dev} was idle for {h} days.", "Le compteur {dev} est resté arrêté {h} jours.", "Il contatore {dev} è fermo da {h} giorni.", "Seriennummer {dev}", "verschickt von meinem {dev}", "written on a {dev}", "Mitglied seit {y}, {c} Einträge", "Joined {y} | {c} notes", "Koordinaten {lv} / {lv}, Blatt {h}", "Parzelle {lv}/{lv} ist überbaut.", "Plan {lv}-{lv}", "ISBN {ean} ist vergriffen.", "Book {ean} is out of print.", "L'ouvrage {ean} est épuisé.", "Zahlungszweck: {ref}", "Referenznummer {ref} angeben.", "Ref. {ref}", "Rechnung {c}-{y}, fällig am {date}.", "Invoice {c}-{y} is due on {date}.", "Facture {c}-{y} du {date}.", "Es kostet {h}.{h} CHF statt {c} CHF.", "Total {c}.{h} EUR, Posten Nr. {h}-{y}.", "Bus {h}, Gleis {h}, Halt {s}.", "Line {h} stops at {s} every {h} minutes.", "Faktor 1.{h} gilt für die {s}.", "A rate of 0.{h} holds for {s}.", "Ausgabe {y}-{c}", "Band {h}, Seite {c}, {y}.", "Version 2.{h}.{h}",
    "Gegen {h} Uhr schliesst die {noun}.", "Ab {h} Uhr bleibt die {noun} zu.", "Vers {h} h la porte se ferme.", "Dès {h} h le guichet ouvre.", "Verso le {h} arriva la posta.", "Dalle {h} alle {h} si mangia.", "Around {h} the gate closes.", "By {h} everyone had left.", "Am {date} um {h} Uhr", "Im {month} {y} waren es {c} Gäste.", "In {h} Minuten geht die {noun} auf.", "Faktor 2.{h} für die {noun}", "Am Eingang {s} wird gebaut.", "Wer kennt die neue {noun} beim Platz {s}?", "Filiale {s}, {noun} im Keller", "Die {noun} am Ort {t} fehlt.", "Station {t}, Halle {h}", "Abteilung {noun} und Abteilung {noun} teilen sich die {noun}.", "Der  Faktor  1 .{h}  gilt  nicht .", "Ein Anteil 0 .{h} bleibt.", "Letzten Sommer war die {noun} zu.", "Nächsten Herbst kommt die {noun}.", "Anteil {h} %, Rest {h} %", "Seite {h} fehlt.", "Punkt {h} des Protokolls", "Stufe {h}, Klasse {h}b",
    "Die {t}er {noun} wird {y} erneuert.", "In {t} gibt es keine {noun}.", "{t} liegt bei {t}.", "Der Zug nach {t} fällt aus.", "The fair in {t} starts in {month}.", "La foire de {t} commence en {y}.", "La fiera di {t} inizia nel {y}.", "{month} {y}: {noun} und {noun} geliefert", "Im {month} räumt die Arbeitsgruppe {noun} den {noun} auf.", "Das Team {noun} prüft die {noun} jeden {day}.", "Am {day} bleibt die {noun} wegen Inventur zu.", "Every {day} the Garden Society meets in the Old Hall.", "Le Comité de Quartier se réunit le {day}.", "La Commissione Edilizia si riunisce {day}.", "Der neue Abwart der Genossenschaft {noun} heisst willkommen.", "Nach dem Umbau glänzt die {noun} wieder, obwohl {day} war.", "ALLE MIETER RÄUMEN DIE {noun} BIS {day}.", "NO ENTRY AT THE {noun} UNTIL {day} PLEASE.", "LA {noun} RESTE FERMÉE LE {day}.", "DIE {noun} BEI DER {s} IST GESPERRT.", "SEIT {day} STEHT DIE {noun} IM {noun}.", "Wer hat die {noun} gesehen?", "Wer kennt sich aus mit {noun} und {noun}?", "Danke!", "Guten Abend", "Liebe Nachbarn", "Dear all", "Chers voisins", "Cari vicini", "[...]", "(gelöscht)", "Stille Nacht, Heilige Nacht", "Eile mit Weile", "Carpe Diem", "Home Sweet Home", "Vive la République", "laden.example.net/angebot?id={c}", "[url=laden.example/p/{h}]Seit {y} im Angebot.[/url]", "{c} {h} {c}", "{y}-{c}", "{noun} {h}", "Das Haus Nr. {h} bleibt leer.", "Zimmer {h} und {h}, Stock {h}", "Gruppe {h} sammelt {day}, Gruppe {h} am {date}.", "Um {time} öffnet die Kasse, {c} Karten bleiben.",
]
ROLES = {"role": "Stadtrat Gemeindepräsident Präsident Direktor Abteilungsleiter Vorsitzende Hauswart Gemeinderat Kantonsrat".split(), "Erole": "President Mayor Chairman Treasurer Director".split(), "Frole": "Président Directeur Maire Trésorier Conseiller".split(), "Irole": "Sindaco Direttore Presidente Cassiere".split()}
MONTHS = "Januar Februar März Mai Juni Juli August September Oktober November Dezember May June July mars avril maggio giugno".split()
DAYS = "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Monday Tuesday Friday lundi mardi vendredi lunedì sabato".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.heads = [self.syllable(True).capitalize() for _ in range(24)]
        tails = [self.syllable(False) + self.r.choice(["", "er", "i", "e"]) for _ in range(15)]
        made = [h + t for h in self.heads for t in tails]
        self.r.shuffle(made)
        self.listed, self.unlisted = made[: len(made) // 2], made[len(made) // 2 :]
        self.alien = [self.syllable(True).capitalize() + self.syllable(False) + self.r.choice(["", "o", "a", "sky", "sen"]) for _ in range(80)]
        self.given = GIVEN[: len(GIVEN) // 2]
        self.lexicon = Lexicon(self.given, self.listed)
        self.towns = [self.syllable(True).capitalize() + self.r.choice("ikon wil hausen bach berg au et ens y ico ate".split()) for _ in range(40)]
        self.towns += [f"{self.r.choice(['Bad', 'Saint', 'Ober', 'Pré', 'Mont'])}-{x}" for x in self.towns[:12]]
        self.towns += [f"{x}-{self.r.choice(['Dorf', 'Stadt', 'Berg', 'le-Lac', 'Haut'])}" for x in self.towns[12:24]]
        self.places = [self.syllable(True).capitalize() + self.syllable(False) for _ in range(40)] + self.heads[:8]
        self.persons: list[tuple[str, str]] = []

    def syllable(self, first: bool) -> str:
        r = self.r
        s = r.choice(ONSETS) + r.choice(VOWELS) + r.choice(CODAS)
        return s if len(s) > 3 or not first else s + r.choice("lnrst")

    def family(self) -> str:
        r = self.r
        x = r.random()
        one = lambda: r.choice(self.listed if r.random() < 0.55 else self.unlisted if r.random() < 0.8 else ODD if r.random() < 0.4 else self.alien)
        if x < 0.12:
            return f"{one()}-{one()}"
        if x < 0.2:
            return f"{r.choice(PART)} {one()}"
        return one()

    def misspelt(self, s: str) -> str:
        """Two letters swapped, or one left out, now and then."""
        r = self.r
        if len(s) < 6 or r.random() > 0.06:
            return s
        i = r.randint(1, len(s) - 3)
        if not (s[i].isalpha() and s[i + 1].isalpha() and s[i].islower() and s[i + 1].islower()):
            return s
        return s[:i] + s[i + 1] + s[i] + s[i + 2 :] if r.random() < 0.5 else s[:i] + s[i + 1 :]

    def person(self) -> tuple[str, str]:
        if self.persons and self.r.random() < 0.6:
            return self.r.choice(self.persons)
        return self.r.choice(GIVEN), self.family()

    def name(self) -> str:
        r = self.r
        g, f = self.person()
        f = self.misspelt(f)
        x = r.random()
        s = f"{g[0]}. {f}" if x < 0.13 else f"{f}, {g}" if x < 0.22 else f"{f} {g}" if x < 0.26 else f"{g} {f}"
        return s.upper() if r.random() < 0.06 else s

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self) -> str:
        r, d = self.r, self.digits
        a = r.choice(["76", "78", "79", "44", "52", "43", "31", "61"])
        b, c, e = d(3), d(2), d(2)
        sep = r.choice([" ", " ", ".", "-", "/"])
        return r.choice([f"0{a} {b} {c} {e}", f"0{a}{sep}{b}{sep}{c}{sep}{e}", f"+41 {a} {b} {c} {e}", f"+41 (0){a} {b} {c} {e}", f"+41{a}{b}{c}{e}", f"0041 {a} {b}{c}{e}", f"(0{a}) {b} {c} {e}", f"0{a}/{b}.{c}.{e}", f"+41-{a}-{b}-{c}-{e}", f"0{a}{b}{c}{e}", f"+33 1 {c} {e} {c} {e}", f"01.{c}.{e}.{c}.{e}", f"020 7946 0{b}", f"+44 20 7946 0{b}", f"({r.randint(202, 989)}) 555-01{c}", f"{r.randint(202, 989)}-555-01{c}", f"+1 ({r.randint(202, 989)}) 555-01{c}"])

    def email(self) -> str:
        r = self.r
        g, f = self.person()
        g, f = (re.sub(r"\W", "", x).lower() for x in (g, f))
        user = r.choice([f"{g}.{f}", f"info+{f}", f"{f}{r.randint(1, 99)}", f"{g}_{f}", f"{g[0]}{f}"])
        host, tld = r.choice(["post.mail", "example", "wolke", "kasten.mail"]), r.choice(["net", "org", "test", "com", "ch"])
        at = r.choice(["@"] * 6 + ["[at]", " (at) ", "&#64;", " ät ", " at ", " arobase ", "{at}"])
        dot = r.choice([".", "[dot]"]) if at == "[at]" else " dot " if at == " at " else " punkt " if at == " ät " else " point " if at == " arobase " else "."
        s = f"{user}{at}{host.replace('.', dot)}{dot}{tld}"
        return s.upper() if r.random() < 0.05 else s

    def document(self) -> str:
        r = self.r
        if r.random() < 0.4:
            return r.choice("CSXEFA") + r.choice(["", " "]) + self.digits(7)
        while True:
            d = "756" + self.digits(10)
            if ahv_valid(d):
                break
        return r.choice([d, f"{d[:3]}.{d[3:7]}.{d[7:11]}.{d[11:]}", f"{d[:3]} {d[3:7]} {d[7:11]} {d[11:]}"])

    def street(self) -> str:
        r = self.r
        return r.choice(self.places + self.listed[:30]) + r.choice(STREET_TAILS[:-2] + ["brücke", "unterführung"] if r.random() < 0.8 else STREET_TAILS[:-2])

    def address(self) -> str:
        r = self.r
        n = f"{r.randint(1, 199)}{r.choice(['', '', '', 'a', 'b', ' c', ' d'])}"
        x = r.random()
        at = lambda p: r.choice(p).replace("{t}", r.choice(self.places).lower() if "er{t}" in p else r.choice(self.places)).replace("{T}", r.choice(self.places))
        line = f"{n}, {at(FOREIGN)}" if x < 0.16 else f"{at(FOREIGN)} {n}" if x < 0.28 else f"{at(BARE)} {n}" if x < 0.42 else f"{r.choice(self.places + self.listed[:30])}{r.choice(STREET_TAILS)} {n}"
        if r.random() < 0.6:
            line += f"{r.choice([', ', ', ', ' '])}{r.choice(['', '', 'CH-'])}{r.randint(1000, 9699)} {r.choice(self.towns)}"
        return line

    def slot(self, k: str) -> tuple[str, str | None]:
        r = self.r
        date = lambda: r.choice([f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(2009, 2025)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(2009, 2025)}", f"{r.randint(2009, 2025)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(2009, 2025)}"])
        make = {
            "N": (self.name, "N"), "T": (lambda: self.misspelt(self.person()[1]), "N"), "A": (self.address, "A"), "E": (self.email, "E"), "P": (self.phone, "P"), "D": (self.document, "D"),
            "g": (lambda: r.choice(GIVEN), None), "s": (self.street, None), "t": (lambda: r.choice(self.towns), None), "noun": (lambda: r.choice(NOUNS), None),
            "h": (lambda: str(r.randint(3, 99)), None), "c": (lambda: r.choice([str(r.randint(5, 45000)), f"{r.randint(1, 45)}'{self.digits(3)}"]), None), "y": (lambda: str(r.randint(2009, 2026)), None),
            "date": (date, None), "time": (lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}", None), "handle": (lambda: r.choice(["gast", "mieter", "blume", "haus", "noname"]) + r.choice(["_", ".", ""]) + r.choice(["nord", "tom", "star", "peter"]) + str(r.randint(1, 999)), None),
            "dev": (lambda: r.choice("ABCDEFGHKLMNPRSTWXYZ") + r.choice(["QL", "T", "7B", "2K"]) + self.digits(8), None), "lv": (lambda: f"{r.choice('12')}{self.digits(6)}", None), "ref": (lambda: f"{r.choice(['00', '01', '21', '96'])} 0{self.digits(4)} {self.digits(r.choice([3, 5, 5]))} {self.digits(4)}", None), "ean": (lambda: "97" + r.choice("89") + self.digits(10) if r.random() < 0.5 else "76" + r.choice("012345789") + self.digits(10), None),
            "HF": (lambda: r.choice(["Herr", "Frau"]), None), "HM": (lambda: r.choice(["Mr", "Mrs", "Ms", "Madame", "Monsieur", "Mme"]), None), "HI": (lambda: r.choice(["signor", "signora"]), None), "month": (lambda: r.choice(MONTHS), None), "day": (lambda: r.choice(DAYS), None),
            "tel": (lambda: r.choice(["Tel. ", "T ", "Mobil: ", "☎ ", "tél. ", "Phone: "]), None), "mail": (lambda: r.choice(["Mail: ", "E-Mail ", ""]), None), "idl": (lambda: r.choice(["AHV ", "AHV-Nr. ", "SSN ", "No AVS ", "Pass-Nr. ", "passport no. ", "Ausweis: ", "ID-Karte ", "carte d'identité "]), None),
            **{k: (lambda k=k: r.choice(v), None) for k, v in ROLES.items()},
        }
        f, label = make[k]
        return f(), label

    def fill(self, template: str) -> tuple[str, list[tuple[str, int, int]]]:
        out, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+)\}", template):
            out += " ".join(map(self.misspelt, template[at : m.start()].split(" ")))
            s, label = self.slot(m[1])
            if label:
                spans.append((label, len(out), len(out) + len(s)))
            out += s
            at = m.end()
        return out + template[at:], spans

    def marked(self, s: str, sp: list) -> tuple[str, list]:
        """Remains of markup around a part."""
        if self.r.random() < 0.75:
            return s, sp
        a, e = self.r.choice([("", "[/quote]"), ("[quote=gast]", ""), ("[b]", "[/b]"), ("<i>", "</i>"), ("", "<br />"), ("", " &amp; so"), ("&nbsp;", ""), ("<p>", ""), ("[img]", ""), ("", "&lt;/div&gt;"), ("[color=blue]", "[/color"), ("", "\n[...]"), ("", "[/QUOTE]")])
        return a + s + e, [(k, x + len(a), y + len(a)) for k, x, y in sp]

    def document_text(self) -> tuple[str, list[tuple[str, int, int]]]:
        r = self.r
        self.persons = [(r.choice(GIVEN), self.family()) for _ in range(2)]
        parts: list[tuple[str, list]] = []
        for _ in range(r.randint(1, 5)):
            s, sp = self.fill(r.choice(PLAIN if r.random() < 0.55 else PERSONAL))
            if s[-1] == "." and r.random() < 0.25:  # full stops get lost
                s = s[:-1] + r.choice(["", " :-)", " ;)", " ***"])
            parts.append(self.marked(s, sp))
        if r.random() < 0.4:
            parts.append((r.choice(BYE), []))
            parts.append(self.marked(*self.fill(r.choice(SIGNED))) if r.random() < 0.75 else self.fill(r.choice(["{g}", "Eile mit Weile", "Joined {y} | {c} notes"])))
        quote = r.choice(["", "", "", "", "> ", "| ", ">", "&gt; ", "> > ", "<p>"])
        text, spans = "", []
        for k, (s, sp) in enumerate(parts):
            if k:
                text += r.choice([" ", "\n", "\n"]) if parts[k - 1][0] not in BYE else "\n"
            if quote and (not text or text[-1] == "\n"):
                text += quote
            if quote and "\n" in s:  # every line of a quoted signature is marked
                move = lambda at: at + len(quote) * s.count("\n", 0, at)  # noqa: B023, E731
                sp = [(kind, move(a), move(e)) for kind, a, e in sp]
                s = s.replace("\n", "\n" + quote)
            spans += [(kind, a + len(text), e + len(text)) for kind, a, e in sp]
            text += s
        if r.random() < 0.05:
            text = text.upper() if len(text.upper()) == len(text) else text
        return text, spans


def sample(n: int, seed: int) -> tuple[Lexicon, list[tuple[str, list[tuple[str, int, int]]]]]:
    """n generated texts with their spans (labels N, A, E, P, D), and the lexicon they go with."""
    m = Maker(seed)
    return m.lexicon, [m.document_text() for _ in range(n)]
