"""Texts written by hand, apart from the label generator: {kind:item} marks each item. Invented persons and numbers."""

TEXTS = """
I spoke to {name:John Smith} about the boiler last week and he promised to send somebody.
The minutes were taken by {name:Sarah Johnson}; please tell her if anything is missing.
{name:Olivia Thompson} has been our treasurer since the spring.
The concert hall was planned together with {name:Frank Gehry} and a small team.
My cousin {name:Ngozi Okafor} can translate the letter for you.
When the parcel arrived, {name:Daniel Hughes} signed for it at {address:14 Victoria Road, Leeds LS6 1AB}.
Rent goes to {name:Margaret O'Neill}, IBAN {id_number:GB29 NWBK 6016 1331 9268 19}, by the first of each month.
Her NHS number is {id_number:943 476 5919} and she was seen on Tuesday.
For refunds, email {email:refunds.desk@northernrail.example} or ring {phone:0161 496 0123}.
Dr {name:Priya Nair} will call you back on {phone:+44 7700 900461} this afternoon.
The witness, {name:Robert Klein}, lives at {address:220 Elm Street, Springfield, OH 45501} with his sister.
Applicant: {name:Christopher Wallace}, SSN {id_number:219-09-9999}, phone {phone:(614) 555-0178}.
Please forward everything to {name:Emily Carter} ({email:emily.carter@ledgerworks.example}).
We were lucky that {name:Kevin O'Donnell} knew the road through the Black Forest.
Send the keys to {address:P.O. Box 1184, Denver 80201} and write to {email:keys (at) lockshop (dot) example}.
The office moved to {address:1600 Pennsylvania Avenue NW, Washington 20500} in May.
Thanks again, {name:Andrew Mills}
Passport {id_number:C01X00T47} was reported lost by {name:Thomas Becker}.
In the end {name:Elizabeth Warren} and {name:Michael Novak} shared the prize money.
You may reach the caretaker at {phone:020 7946 0958} until noon; ask for Mr {name:K. Boateng}.
The Great Western Railway stops at Paddington Station every Monday Morning.
Our trip to New York ended at the Museum of Modern Art near Central Park.
The Martin Luther Church stands beside the Albert Einstein School.
Chapter 12 explains how the Red Cross and the United Nations work together.
Part 4711-0815 costs 1,299.00 dollars, order 2024-11873, invoice 00045512.
On 12.03.2019 at 14:30 the server 192.168.10.24 answered with code 40400.
Microsoft Office and Adobe Reader were installed on Friday Evening.
Gestern hat {name:Wolfgang Schneider} die Unterlagen im Rathaus abgegeben.
Bitte rufen Sie {name:Ursula Hoffmann} unter {phone:0221 4710 815} zurück.
{name:Jörg Baumgartner} wohnt in der {address:Schillerstraße 27, 50674 Köln} und ist selten zu Hause.
Überweisen Sie den Betrag auf {id_number:DE89 3704 0044 0532 0130 00}, Kontoinhaber {name:Klaus Richter}.
Meine Steuer-ID lautet {id_number:36 574 261 809}, das Formular liegt bei.
Schreiben Sie bitte an {email:vorstand@kleingarten-sued.example} oder an {name:Monika Lehmann}.
Die Vermieterin, {name:Sabine Krause}, ist mobil unter {phone:+49 171 5550193} erreichbar.
Wir treffen uns am {address:Alter Markt 3, 24103 Kiel} um acht.
Der Antrag von {name:Ahmed Yıldız} wurde am Montag bewilligt.
Am Alten Markt beginnt das Große Stadtfest mit der Freiwilligen Feuerwehr.
Die Bayerische Staatsbibliothek zeigt Briefe aus dem Ersten Weltkrieg.
Das Bürgerliche Gesetzbuch und die Deutsche Post kamen in Kapitel Vier vor.
Die Johann-Wolfgang-Goethe-Universität liegt in Frankfurt am Main.
Hier soir {name:Camille Lefort} nous a montré ses photos de vacances.
Veuillez contacter {name:Jean-Pierre Morel} au {phone:01 42 68 53 00} avant vendredi.
{name:Amélie Rousseau} habite {address:12 bis, rue des Lilas, 69003 Lyon} depuis dix ans.
Mon numéro de sécurité sociale est le {id_number:2 69 05 49 588 157 80}.
Le dossier de {name:Nathalie Girard} a été transmis à la mairie par {name:Luc Besnard}.
Pour toute question, écrivez à {email:accueil@mairie-villeneuve.example}.
Le virement est à faire sur le compte {id_number:FR76 3000 6000 0112 3456 7890 189}.
Le Conseil Municipal se réunit à la Salle des Fêtes de Saint Malo.
La Tour Saint Jacques domine le quartier du Grand Marché.
Les Trois Mousquetaires est un roman publié dans Le Siècle.
Ayer {name:Lucía Fernández} dejó las llaves en la portería.
Llame a {name:Javier Ortega} al {phone:+34 612 345 678} o al fijo {phone:91 555 01 22}.
{name:María del Carmen Ruiz} vive en la {address:Calle de Alcalá 48, 28014 Madrid} con su madre.
Mi DNI es {id_number:12345678Z} y mi correo es {email:pablo.nunez@correo-rapido.example}.
El contrato lo firmó {name:Alejandro Vidal} en nombre de la empresa.
La reunión con {name:Pilar Esteban} será el jueves en el Palacio Real.
El Banco de España y la Real Academia cierran en Semana Santa.
Nuestro viaje a Buenos Aires empezó en la Plaza de Mayo.
La signora {name:Francesca Conti} abita in {address:Via Roma 12, 00184 Roma} al terzo piano.
Mijn buurman {name:Pieter de Vries} woont op {address:Kerkstraat 14, 1017 GJ Amsterdam}.
Меня зовут {name:Иван Петров}, я пишу из отпуска.
""".strip().split("\n")


def parsed() -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, [(kind, item)])."""
    import re

    out = []
    for line in TEXTS:
        items = re.findall(r"\{(\w+):([^{}]*)\}", line)
        out.append((re.sub(r"\{\w+:([^{}]*)\}", r"\1", line), items))
    return out
