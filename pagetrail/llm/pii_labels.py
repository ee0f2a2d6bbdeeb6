"""Labelled sentences for the personal-data model, made from templates with invented values."""

from __future__ import annotations

import random
import re

#: Common given names of several languages.
GIVEN = """Anna Maria Helena Julia Clara Nora Lena Vera Sonia Ingrid Greta Irene Iris Rosa Rose Violet Jade Teresa Amina Leila Zoe Mei Paula Petra Nadia Amelie
Anne-Marie Emma Sofia Laura Eva Marta Elena Lucia Carmen Ines Karin Katja Heike Sabine Claire Camille Chloe Louise Alice Grace Ruth Ellen Susan Mary Jane Linda
Stefan Lucas Otto Samuel Martin Karl Jürgen Milan Ivan Rafael Felix Ravi Yusuf Jonas Victor Oskar Pavel Hugo Tomas Kofi Søren Jean-Luc José Jose Daniel Walter Lukasz
Łukasz Peter Paul Hans Erik Anders Lars Nils Jan Piotr Marek Andrej Boris Omar Ali Hassan Ahmed David John James Robert Michael William Thomas Henry George Pierre Michel
Antoine Luis Carlos Miguel Juan Pedro Diego Marco Luca Giulia Paolo Wei Jin Kenji Yuki Arjun Priya Kwame Chidi
Sarah Olivia Jessica Emily Charlotte Elizabeth Jennifer Karen Barbara Margaret Patricia Christine Frank Richard Charles Joseph Christopher Matthew Mark Andrew Kevin Brian
Wolfgang Klaus Jörg Uwe Dieter Ursula Monika Petr Sergei Dmitri Olga Tatiana Natalia Isabel Pilar Javier Fernando Alejandro Manuel Ana Nicolas Philippe Jacques François Sophie
Hélène Giovanni Francesca Matteo Fatima Aisha Mohammed Ibrahim Ngozi Hiroshi""".split()

#: Family names of several languages; the model sees invented ones too, so it doesn't depend on these.
FAMILY = """Smith Johnson Brown Taylor Wilson Evans Thomas Roberts Walker Wright Thompson White Hughes Green Hall Wood Clarke Jackson Harris Cooper Ward Turner Miller Baker King Parker
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hartmann Lange
Martin Bernard Dubois Durand Moreau Laurent Lefebvre Leroy Roux Girard Bonnet Dupont Lambert Fontaine Rousseau Blanc Garnier Faure Mercier
García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Ruiz Hernández Díaz Moreno Álvarez Romero Navarro Torres Domínguez Vázquez Ramos
Rossi Bianchi Esposito Ricci Conti Jansen Bakker Visser Hansen Nielsen Larsen Lindqvist Virtanen Kowalski Novák Horváth Popescu Ivanov Petrov Sokolov
Nguyen Tanaka Suzuki Kim Park Chen Wang Singh Patel Khan Okafor Mensah Adeyemi Haddad Cohen""".split()
_CYRILLIC = "Иван Мария Сергей Ольга Дмитрий Анна Алексей Елена".split(), "Петров Иванова Смирнов Кузнецова Попов Волков Соколова Морозов".split()
_PARTICLES = "van|van der|von|de|de la|del|di|da|bin|el".split("|")
_SOUNDS = "b br ch d dr f g gr h j k kl l m n p pr r s sh st t tr v w z".split(), "a e i o u ai ou ie".split(), ["", "", "n", "r", "s", "l", "k", "m"]

_ROOTS = "Hal Kest Dorv Oskar Vel Brin Torv Lind Mor Rav Sten Zell Parn Quil Tav Fenn Grod Jarn Ulm Wesk Hask Lund Sand Holm Berg Nov Petr Kow Mar Ols".split()
_ENDS = "wicz ovic marsk strup mund etti enko inen eney olay ardo kor vane osh agan idou élis nöde sen son ski ez mann berg ova".split()
_PLACES = "Kel Vor Tha Dru Sti Gam Lob Pes Zar Fim Mub Nek Rov Tus".split()
_TOWN_A = "Brind Sall Far Lom Gors Hulm Kesta Mirre Norha Oster Pedra Quen Tave Varl Weth Dor".split()
_TOWN_B = "wick ford stedt berg bury ham ven vath mere lin onne zow val rona".split()
_STREETS = "Larkmoor Weaver Tanner Kiln Foundry Heron Harrow Quarry Chapel Beacon Willow Millrace Saltmarsh Maple Station".split()
_NOUNS = "river canal tower museum bridge garden market quarry island library school court harbour".split()


class _Maker:
    def __init__(self, rng: random.Random):
        self.r = rng

    def pick(self, *options):
        return self.r.choice(options)

    def sounds(self, least: int = 2) -> str:
        return "".join(self.r.choice(part) for _ in range(self.r.randint(least, 3)) for part in _SOUNDS).capitalize()

    def family(self) -> str:
        x = self.r.random()
        if x < 0.45:
            return self.r.choice(FAMILY)
        if x < 0.6:
            return self.sounds()
        f = self.r.choice(_ROOTS) + self.r.choice(_ENDS)
        x = self.r.random()
        return f"O'{f}" if x < 0.06 else f"{f}-{self.r.choice(_ROOTS)}{self.r.choice(_ENDS)}" if x < 0.14 else f

    def given(self) -> str:
        return self.r.choice(GIVEN) if self.r.random() < 0.95 else self.sounds(1)

    def known(self) -> str:
        return self.r.choice(GIVEN)

    def name(self) -> str:
        if self.r.random() < 0.03:
            return f"{self.r.choice(_CYRILLIC[0])} {self.r.choice(_CYRILLIC[1])}"
        g, f = self.given(), self.family()
        if self.r.random() < 0.05:
            f = f"{self.r.choice(_PARTICLES)} {f}"
        if self.r.random() < 0.05:
            g = f"{g}{self.pick('-', ' ', ' del ')}{self.given()}"
        i = self.r.choice("ABCDEHJKLMNPRST") + "."
        out = self.r.choices([f"{g} {f}", f"{g} {i} {f}", f"{g[0]}. {f}", f"{f}, {g}", f"{f}, {g[0]}.", f"{g[0]}. {i} {f}"], [48, 12, 14, 16, 4, 6])[0]
        return out.upper() if self.r.random() < 0.07 else out

    def town(self) -> str:
        return self.r.choice(_TOWN_A) + self.r.choice(_TOWN_B)

    def place(self) -> str:
        return (self.r.choice(_PLACES) + self.r.choice("aeiou") + self.r.choice(_PLACES).lower() + self.r.choice(["", "on", "as", "il"])).capitalize()

    def n(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def num(self, top: int) -> int:
        return self.r.randint(1, top)

    def phone(self) -> str:
        n, p = self.n, self.pick
        us, sep = f"{p('202', '312', '415', '617', '808')}", p("-", ".", " ")
        return p(
            f"+1 {us}-555-{n(4)}", f"({us}) 555-{n(4)}", f"{us}{sep}555{sep}{n(4)}", f"+1{us}555{n(4)}", f"1 {us} 555 {n(4)}",
            f"+44 1632 {n(6)}", f"(01632) {n(6)}", f"01632 {n(3)} {n(3)}", f"0044 20 7946 {n(4)}", f"+61 491 570 {n(3)}", f"0491 570 {n(3)}",
            f"+49 30 {n(5)} {n(3)}", f"(030) {n(5)} {n(3)}", f"030 / {n(8)}", f"0049-30-{n(5)}-{n(3)}", f"+34 {n(3)} {n(2)} {n(2)} {n(2)}", f"0034-{n(3)}-{n(2)}-{n(4)}",
            f"{p('455', '612', '911')} {n(2)} {n(2)} {n(2)}", f"{p('7', '6', '9')}{n(2)} {n(3)} {n(3)}", f"020 7946 {n(4)}", f"9{n(1)} {n(3)} {n(2)} {n(2)}", f"+39 06 {n(4)} {n(4)}", f"+31 20 {n(3)} {n(4)}", f"07700 900{n(3)}", f"+7 495 {n(3)}-{n(2)}-{n(2)}", f"06 {n(2)} {n(2)} {n(2)} {n(2)}", f"0151 {n(8)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"+33 1 {n(2)} {n(2)} {n(2)} {n(2)}", f"01 {n(2)} {n(2)} {n(2)} {n(2)}", f"01.{n(2)}.{n(2)}.{n(2)}.{n(2)}", f"0033 1{n(2)} {n(2)} {n(2)} {n(2)}",
        )

    def iban(self) -> str:
        gap = self.pick("", " ")
        return self.pick("DE", "FR", "ES", "NL", "IT", "GB") + self.n(2) + gap + gap.join([self.pick(self.n(4), "BKXY"), *(self.n(4) for _ in range(3)), self.n(2)])

    def id(self) -> str:
        n, p, c = self.n, self.pick, self.r.choice("ABCDPTX")
        sep = p("-", " ")
        if self.r.random() < 0.4:  # bank accounts, social insurance and tax numbers of several countries
            return p(self.iban(), f"{n(8)}{c}", f"{n(3)} {n(3)} {n(4)}", f"1 {n(2)} {n(2)} {n(2)} {n(3)} {n(3)} {n(2)}", f"{n(2)} {n(3)} {n(3)} {n(3)}", f"{n(2)} {n(6)} {c} {n(3)}", f"{p('C', 'L', 'T')}{n(2)}{c}{n(5)}", f"{c}{n(2)}{c}{n(2)}{c}{n(2)}")
        return p(f"{p('666', n(3))}{sep}{n(2)}{sep}{n(4)}", f"666{sep}{n(2)}{sep}{n(4)}", f"99{n(4)}-{n(4)}", f"{n(3)}/{n(3)}/{n(5)}", f"QQ{n(6)}{c}", f"QQ {n(2)} {n(2)} {n(2)} {c}", f"{n(2)}-{n(3)}-{n(3)}-{c}", f"{p('X', 'Z', 'C')}{n(8)}")

    def email(self) -> str:
        g, f = self.given().lower(), self.family().lower().replace("'", "")
        p = self.pick
        local = p(f"{g}.{f}", f"{g}-{f}.{self.num(99)}", f"{f}_{g}", f"{g}{self.num(99)}", f"{g}+wiki{self.num(99)}", f"info.{f}", f"{g[0]}{f}")
        host = [*p(["mail"], ["post"], ["archive"], ["talk-pages"], ["uni-" + self.town().lower()], ["users", "example"], ["dump", "example"], ["example"]), p("org", "com", "net", "test", "invalid", "example")]
        if len(host) == 1:
            host.insert(0, "example")
        x = self.r.random()
        if x < 0.8:
            out = f"{local}@{'.'.join(host)}"
            return out.upper() if x < 0.07 else out
        at, dot = p((" (at) ", " (dot) "), (" AT ", " DOT "), (" at ", " dot "), (" [at] ", "."), (" [at] ", " [dot] "), (" (at) ", "."), ("(at)", "(dot)"))
        return local + at + dot.join(host)

    def address(self) -> str:
        p, t = self.pick, self.town()
        gap = self.r.choices([", ", ",\n", "\n"], [70, 20, 10])[0]
        no = f"{self.num(299)}{p('', '', '', 'a', 'b', 'c')}"
        road = f"{no} {p(*_STREETS, 'Old Orchard')} {p('Road', 'Rd', 'Street', 'St.', 'Avenue', 'Ave', 'Lane', 'Close', 'Court', 'Boulevard')}"
        flat = f"{p('Flat', 'Apt', 'Unit')} {self.num(40)}, {road}"
        five = self.n(5)
        if self.r.random() < 0.3:
            town, fam = p(t, t, "Berlin", "Paris", "Madrid", "Leeds", "Springfield", "Lyon", "Köln", "Bad " + t, "New " + t), self.r.choice([f for f in FAMILY if f.isascii()])
            return p(
                f"{no} {fam} {p('Street', 'Road', 'Avenue', 'Lane', 'Drive', 'Way')} {p('NW', 'SE', 'N')}{gap}{town}, {p('KL', 'CA', 'NY', 'TX')} {five}", f"{no} {p('High', 'Church', 'Main', 'Station', 'Park')} Street{gap}{town} {p('SW', 'LS', 'M')}{self.num(20)} {self.num(9)}{p('AB', 'QT', 'XY')}",
                f"Via {p('Roma', 'Garibaldi', 'Dante', 'della Pace')} {self.num(200)}{gap}{five} {p(town, 'Milano', 'Torino')}", f"{p('Kerk', 'Dorps', 'School', 'Molen')}{p('straat', 'laan', 'weg')} {self.num(200)}{gap}{self.n(4)} {p('AB', 'KL')} {p(town, 'Utrecht')}",
                f"{no} {p('Elm', 'Oak', 'Cedar', fam)} {p('Street', 'Avenue', 'Drive')}{gap}{town}, {p('CA', 'NY', 'TX', 'OH')} {five}", f"{p('Alter', 'Neuer')} {p('Markt', 'Weg', 'Platz')} {self.num(90)}{gap}{five} {town}", f"{p('Haupt', 'Berliner ', 'Garten', 'Schul')}{p('straße', 'strasse', 'str.')} {self.num(200)}{gap}{five} {town}".replace("er s", "er S"),
                f"{self.num(200)} rue {p('Victor Hugo', 'de la Paix', 'du Bac', 'Saint-Jacques')}{gap}{five} {town}", f"Calle {p('de Alcalá', 'Mayor', 'Gran Vía')}{p(',', '')} {self.num(200)}{gap}{five} {town}",
            )
        return p(
            f"{road}{gap}{t} {five}", f"{road}{gap}{t} {five}", f"{road}{gap}{t}", f"{flat}{gap}{t}, {p('KL', 'QW', 'DV')} {five}", f"{p('P.O.', 'PO')} Box {self.num(9999)}{gap}{t} {five}",
            f"{road}{gap}{t} {p('ZV', 'QX')}{self.num(9)} {self.num(9)}{p('QZ', 'VX', 'AB')}",
            f"{p('Hafenplatz', 'Lindenallee', 'Mühlstraße', 'Kirchgasse', 'Tannenstr.', 'Gartenweg')} {self.num(299)}{p('', 'a', ' b')}{gap}{p('', 'D-')}{five} {t}",
            f"{self.num(299)}{p('', ' bis')}, {p('rue des Peupliers', 'avenue du Moulin', 'boulevard de la Tour', 'impasse des Lilas', 'chemin du Lavoir')}{gap}{five} {t}",
            f"{p('Calle del Olmo', 'C/ Mayor', 'Plaza de la Fuente', 'Paseo del Molino')} {self.num(299)}{p('', ', 2.º B', ', bajo')}{gap}{five} {t}",
        )


_POSITIVE = """Please ask {name} before moving the page.|Thanks to {name} for the fix.|I am {name} and I edit bridge articles.|My teacher, Mrs {name}, wrote the first version.
This was reported by {name} (new editor).|The subject, {name}, asked for the section to be removed.|The photo was taken by Dr. {name} last spring.|-- {name}\n|Signed: {name}\n|Gruß, {name}\n|Signé : {name}\n|Firmado: {name}\n
Ich bin {name} und pflege die Kanalartikel.|Danke an {name} für die Korrektur.|Soy {name} y reviso los canales.|Gracias a {name} por la corrección.|Je suis {name} et je relis les ponts.|Merci à {name} pour la correction.
Bitte Herrn {name} fragen.|Bitte Frau {name} fragen.|Demandez à M. {name} avant.|Demandez à Mme {name} avant.|Pregunte a Sra. {name} antes.|{name} <{email}> wrote:|{name} ({phone}, {email}) holds the map.
Contact {name}, {address} or {phone}.|{name}, {address}, Tel. {phone}.|{name}, {address}, tél. {phone}.|I live at {address}, near the canal.|Address: {address}\n|The letter was sent from {address}.|Mail the book to {address}.
Anschrift: {address}\n|Dirección: {address}\n|Adresse : {address}\n|Ich wohne {address}.|J’habite {address}.|Vivo en {address}.|Envoyez le livre au {address}.|Envíe el libro a {address}.|Schick das Buch bitte an {address}.
Call {phone} after six.|Ring {phone}.|tel. {phone}, ask for the archive.|Phone: {phone}\n|My number {phone} is on the old talk page.|The museum desk ({phone}) confirmed it.|Das Archiv ({phone}) hat es bestätigt.|Le musée ({phone}) confirme.
El museo ({phone}) lo confirma.|Telefon: {phone}\n|Téléphone : {phone}\n|Teléfono: {phone}\n|Ruf mich unter {phone} an.|Appelez le {phone} le soir.|Llame al {phone} por la tarde.
Write to {email} for the scans.|Contact: <{email}>\n|({email}) |You can reach me at {email}, mostly at night.|e-mail {email}; no attachments.|My address is {email}.|Send the dump log to mailto:{email} please.|Mi correo es {email}.|Kontakt: {email}\n|Schreib an {email} wegen der Scans.
My social security number is {id}.|SSN: {id}\n|Someone posted the tax number {id} in the history.|Remove passport {id} from the infobox.|national insurance no.: {id}\n|My NI number is {id}.|personal code: {id}\n|My tax ID is {id}.|Remove ID card no. {id} from the infobox.
Meine Nummer (tax ID) ist {id}.|Mon numéro (passport) est {id}.|Mi número (identity card) es {id}.|citizen number: {id}\n|Someone posted the personal code {id} in the history.|passport no.: {id}\n|identity card: {id}\n|Remove SSN {id} from the infobox."""
_NEGATIVE = """The {given} Canal and the {given} Quarry were merged.|{given} River, {given} Island and Mount {given} share one map.|{given} (flower) links to {given} (colour).|Catalogue no. 0{n2}-{n2}-{n4} is a map.|Catalogue no. {n3}-{n2}-{n4} is a map.
ISSN {n4}-{n4}, vol. {n2}, no. 4.|See ISBN 978-0-{n3}-{n3}-4, page {n2}.|Revision 1{n9} replaced revision 1{n9}.|{n3} 4 {n2} bytes were saved.|The dump of 2024-0{n1}-1{n1} holds {n2},{n3},{n3} links.|Version 2.{n1}.{n2} of graph@main fixed it.
Ping @{place} and @{place} about this.|{place} Bridge meets {place} Road at the old mill.|Coordinates {n2}.{n3} N, {n1}.{n3} E.|Vertex #1{n9} has 34 links.|Template:{place} takes 3 parameters ({n1}, {n2}, {n3}).|Score 3-2-1, ratio {n2}/{n3}, bug {n4}.
The redirect from {place} points at a stony {noun}.|I think [[{place}]] should link to the {noun}, not to the {noun}.|Warum fehlt der Turm im Artikel {place}?|Der Kanal verbindet {place} mit {place}.|Die Seite über {place} hat {n3} eingehende Links.|La page sur {place} reçoit {n3} liens.
Le port relie {place} à {place}.|El canal une {place} con {place}.|La página de {place} recibe {n3} enlaces.|#{n3} ({place}) -> #{n3} ({place}; displayed as: the {noun}).|Search from #{n3} ({place}) to #{n3} ({place}) found a path of {n3} pages.
Path length 4, reached {n4}, expanded {n2}, edges {n4}.|File size {n2}.{n3} MB, md5 {n9}c.|Between 1{n3} and 1{n3} the old {noun} crosses {n3} smaller works.|The {place} {noun} kept {n3} ledgers at {place}, now lost.|Merged the {noun} section, see the history of {place}.
In 1{n3} the council of {place} closed a wide {noun} and {n3} plots.|Visitors reach the {noun} by the old {place} road.|Two steep gates survive, one facing {place} and one the {noun}.|Im Jahr 1{n3} zählte man {n3} Bahnhof.|On comptait {n2} pont en 1{n3}.|The path from {place} to {place} needs {n3} clicks now.
{place} feeds {place} to the south and the plain {noun} to the west.|Winter storms of 1{n3} drained the blue {place} {noun} twice.|The {given} Prize went to the {noun}.|Lake {given} and {given} Street are old.|A {given} Tower stands in {place}."""


_POSITIVE += """
Yesterday {name} came to the library with a map.|The report was written by {name} in March.|We met {name} and {name} at the station.|{name} said the road was closed.|{name} lives in the old town.|As {name} explained, the dam is safe.
In 2012 {name} moved to the coast.|Then {name} told {name} about it.|{name} was born in 1961.|{name} works for the city.|According to {name}, nothing changed.|The architect {name} drew the plans.|Our neighbour {name} called the police.|Speak with {name} first.
Gestern sprach {name} mit der Verwaltung.|Der Bericht stammt von {name} und {name}.|{name} wohnt seit Jahren in der Altstadt.|Laut {name} ist der Damm sicher.|Die Ärztin {name} kam später.|{name} sagte, die Brücke sei gesperrt.|Wie {name} erklärte, bleibt alles gleich.
Hier, {name} est venu avec une carte.|Le rapport est de {name} et {name}.|{name} habite la vieille ville.|Selon {name}, rien ne change.|L’architecte {name} a dessiné les plans.|{name} travaille pour la mairie.
Ayer {name} vino con un mapa.|El informe es de {name} y {name}.|{name} vive en el casco antiguo.|Según {name}, nada cambia.|La arquitecta {name} hizo los planos.|{name} trabaja para el ayuntamiento.
Dear {name},\n|Dear Mr {name},\n|Best regards,¶{name}\n|Sincerely,¶{name}\n|From: {name} <{email}>\n|To: {name}\n|Name: {name}\n|Patient: {name}, ID {id}\n|Patient {name} was seen on Monday.|Hi {name}, thanks for the call.
Please transfer it to {iban} by Friday.|IBAN: {iban}\n|My IBAN is {iban}.|Das Konto ist {iban}.|NHS number: {id}\n|Her NHS number is {id}.|Steuer-ID: {id}\n|DNI: {id}\n|Mi DNI es {id}.|numéro de sécurité sociale : {id}\n|Personalausweis {id} ist abgelaufen.|Passport number {id} expires soon.
She moved to {address} last year.|Our office is at {address}.|Send the parcel to {address}.|Wir wohnen in der {address}.|Das Büro ist in {address}.|Elle habite {address}.|Vive en {address} desde mayo.|Abita in {address}.|Lieferung an {address}.
You can call me on {phone} or write to {email}.|Mobile: {phone}\n|Fax {phone}\n|Reach us at {phone}.|Text me at {phone}.|Rufen Sie {phone} an.|Mon numéro est le {phone}.|Mi teléfono es {phone}.|Handy: {phone}\n"""
_POSITIVE += "|" + "|".join(["{w} {w} {name} {w} {w} {w}.", "{C} {w} {name}, {w} {w}.", "{w} {C} {name} {w} {w}.", "{C} {name} {w} {C}.", "{w} {w}, {name}, {w} {C}.", "{name} {w} {w} {C} {w}.", "{w} {w} {w} {name}.", "{name}, {C}, {w} {w}.", "{w} {C} {w} {name} {w} {phone} {w}.", "{C} {C} {w} {name} {w}."] * 2)
_NEGATIVE += "\n" + "|".join(["{w} {C} {C} {w} {w}.", "{C} {w} {place} {C} {w}.", "{C} {C} {w} {C}.", "{w} {w} {place} {place} {w}.", "{w} {known} {C} {noun} {w}.", "{known} {w} {w} {C}.", "{C} {w} {w} {n3} {C} {w} {n4}."])
_NEGATIVE += """
The {known} {family} Bridge crosses the {noun}.|The {known} {family} Library opened in 1{n3}.|{family} Street and {family} Road meet there.|The {known} {family} Prize was given twice.|Hotel {known} is closed.|Saint {known} Church stands on {known} Square.
The Town Hall and the Art Museum are near.|He lives in New York and works for the Red Cross.|On Monday Morning the Main Page was edited.|The Prime Minister opened the North Sea port.|Open Source Software runs the Help Desk.|See Also External Links and Further Reading.
Die Deutsche Bahn baut am Alten Markt.|Am Montag Abend spielte der Erste Chor.|Das Rote Kreuz hilft in Sankt {place}.|Guten Morgen Berlin heißt die Sendung.|La Tour Eiffel et le Moyen Âge.|Le Grand Palais reste ouvert.|La Semana Santa y el Banco Central.|Meine Adresse ist {place}.|Unsere Nummer steht im Buch.|Ihre Antwort fehlt noch.|El Museo Nacional abre hoy.
However {place} was never found.|Later {place} joined {place}.|Yesterday London won.|In March {place} and {place} signed the Peace Treaty.|World War Two ended.|The University of {place} and {place} College.|{place} City Council met.|Great {place} Road.|{place} {place} is a river.
The {family} family sold the {noun}.|{family} and Sons built it.|Windows Server and Visual Studio.|Figure {n1} and Table {n1}.|Chapter One begins.|Der Neue Weg und die Alte Straße.|Le Petit Journal.|Los Angeles Times.|Order No. {n3}-{n3}-{n4} was shipped.|Invoice {n3} {n3} {n4} is paid.
Part number {n3}-{n2}-{n4} is out.|Case {n2}/{n3}.|The server 192.168.{n2}.{n1} is down.|Address 10.{n1}.{n2}.{n2} answered.|Host {n2}.{n3}.{n2}.{n2} said {n5}.|Von {n3}.{n2}.{n1}.{n2} kam nichts.|Version {n2}.{n2}.{n2}.{n2} at {n2}:{n2}.|On 0{n1}.0{n1}.19{n2} it rained.|The code {n4}-{n4} opens nothing.|It cost 1.{n3}.{n3} in all.|ISBN {n1}-{n3}-{n5}-{n1}.|{n3} {n3} {n3} people voted.|The Road 12 Avenue plan failed.|In {n4} 12 people left."""


def labelled(count: int, seed: int = 0) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``count`` texts of a few sentences, each with the (kind, start, end) of its personal information."""
    rng = random.Random(seed)
    make = _Maker(rng)
    positive = [t for t in re.split(r"\||(?<!\|)\n(?=\S)", _POSITIVE) if t.strip()]
    positive = [t.replace("¶", "\n") for t in positive]
    positive = [t + "\n" if re.search(r"\}$", t) else t for t in positive]
    negative = [t for t in re.split(r"[|\n]", _NEGATIVE) if t.strip()]
    values = {"name": make.name, "email": make.email, "phone": make.phone, "id": make.id, "iban": make.iban, "address": make.address}
    kinds = {"id": "id_number", "iban": "id_number"}
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(1, 5)):
            template = rng.choice(positive) if rng.random() < 0.6 else rng.choice(negative)
            if text and not text.endswith("\n"):
                text += rng.choices([" ", "\n", "\n\n"], [70, 15, 15])[0]
            for part in re.split(r"(\{\w+\})", template):
                key = part[1:-1] if part[:1] == "{" else ""
                if key in values:
                    value = values[key]()
                    spans.append((kinds.get(key, key), len(text), len(text) + len(value)))
                    text += value
                elif key:
                    text += {"given": make.known, "known": make.known, "family": lambda: rng.choice(FAMILY), "w": lambda: make.sounds(1).lower(), "C": make.sounds, "place": make.place, "noun": lambda: rng.choice(_NOUNS)}.get(key, lambda key=key: make.n(int(key[1:])))()
                else:
                    text += part
        out.append((text, spans))
    return out
