"""Invented texts with known personal details, and word lists, from which the field of pii is trained.

Phrases are of letters, forms, tickets, notes and technical prose in English, German, French and Spanish. None is taken from the data.
"""

from __future__ import annotations

import random
import re

#: Some common given names of the four languages.
GIVEN = set("""
Aaron Adam Alan Albert Alejandro Alex Alexander Alfred Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anna Anne Antoine Antonio Arthur Barbara Beatriz Benjamin Bernd Brian Bruno Camille Carlos Carmen
Caroline Catherine Cecilia Charles Charlotte Chloé Christian Christina Claire Clara Claudia Cristina Daniel David Diego Dieter Dominique Dorothea Edward Elena Elisabeth Elizabeth Emily Emma Eric Erika Esther
Eva Felipe Felix Fernando Florian Francisco Frank Franz Frédéric Gabriel George Gérard Gisela Grace Guillaume Gustav Hannah Hans Heinrich Helen Helga Henry Hugo Ines Ingrid Isabel Isabelle Jack Jacques James
Jan Jane Javier Jean Jennifer Jessica Joan John Jonas Jorge José Joseph Juan Julia Julie Julien Jürgen Karin Karl Katharina Kevin Klaus Laura Léa Lena Linda Lisa Louis Louise Lucas Lucía Luis Luise Manuel
Marc Margaret Maria María Marie Mark Markus Martin Mary Mathilde Matthew Maximilian Mercedes Michael Michel Miguel Monika Nathalie Nicole Nicolas Nora Oliver Olivia Pablo Patricia Paul Paula Peter Petra
Philippe Pierre Pilar Rachel Rafael Ralf Raquel Rebecca René Richard Robert Rosa Ruth Sabine Samuel Sandra Sara Sarah Sergio Silvia Simon Sofía Sophie Stefan Stephen Susan Sylvie Teresa Theo Thomas Tobias
Ulrich Ursula Valérie Verónica Victor Werner William Wolfgang Xavier Yolanda Yves
""".split())  # fmt: skip
#: What people are called by what they do or are to someone, beside titles.
ROLES = set("""
patient customer client tenant employee colleague manager director president chairman chairwoman ceo cto cfo engineer developer architect lawyer attorney judge nurse teacher student pupil captain sergeant officer minister senator secretary
assistant neighbour neighbor witness applicant candidate applicant holder owner author editor translator maintainer reviewer reporter landlord driver plumber coach pastor uncle aunt brother sister husband wife friend son daughter mother father boss
kunde kundin patientin mieter mieterin mitarbeiter mitarbeiterin kollege kollegin chef chefin leiter leiterin richter richterin arzt ärztin anwalt anwältin lehrer lehrerin schüler schülerin nachbar nachbarin zeuge zeugin inhaber inhaberin autor autorin freund freundin
cliente paciente inquilino inquilina empleado empleada jefe jefa director directora ingeniero ingeniera abogado abogada juez profesor profesora alumno alumna vecino vecina testigo titular autora amigo amiga hermano hermana
cliente patiente locataire employé employée collègue directeur directrice ingénieur ingénieure avocat avocate juge professeur élève voisin voisine témoin titulaire auteur autrice ami amie frère sœur
""".split())  # fmt: skip
#: What people do, after their name.
DEEDS = set("""
said says wrote writes asked asks called calls told thinks thought noted notes explained reported suggested pointed argued agreed confirmed mentioned joined lives works signed sent phoned replied answered apologised complained
sagte sagt schrieb schreibt fragte fragt rief meinte meint erklärte bemerkte wohnt arbeitet unterschrieb bestätigte antwortete meldete
dit a écrit demande demanda explique expliqua signale habite travaille répond répondit confirme appelle pense note
dijo dice escribió escribe preguntó pregunta llamó explicó señaló vive trabaja firmó confirmó respondió opina avisó
""".split())  # fmt: skip
#: Words near phone numbers, and near identity numbers.
PHONE_WORDS = set("tel tél telephone phone phoned call calls called mobile cell fax ring dial sms text hotline pager whatsapp reach line landline telefon telefonisch handy mobil mobilnummer durchwahl anrufen ruf rufen rückruf erreichbar téléphone téléphoner appeler appelez portable joindre fixe teléfono móvil llamar llame llámame marque marcar contactar".split())
IDENTITY_WORDS = set("ssn social security passport id identity identification national card ausweis ausweisnummer personalausweis reisepass pass passnummer sozialversicherungsnummer steuernummer identité identite carte passeport sécurité sociale nir insee dni nie nif pasaporte cédula cedula identidad seguridad documento".split())
#: Ordinary words that names of things are made of.
COMMON = set("""
Access Action Alpine Amber Anchor Arrow Autumn Bay Beacon Black Blue Bridge Bright Broad Cache Canal Castle Cedar Center Chapter Circle Cloud Coast Code Copper Core Creek Crystal Data Deep Delta Desk Draft East Edge Engine
Field Final Fire First Flow Forest Form Gate General Getting Glass Gold Golden Grand Green Guide Handbook Harbor Hill House Installation Iron Island Journal Key Lake Lane Large Last Ledger Light Link List Little Log Long Main Manager Manual Map Maple Market
Meadow Mode Model Moon Morning Mountain Network New Night North Notes Oak Ocean Office Old Open Page Park Path Pine Plan Platform Policy Pool Port Product Project Public Quick Rain Red Reference Release Report River Road Rock Room Round Router Safe Sample Scheduler Sea
Second Section Server Service Session Shadow Silver Small Snow South Spring Star Start Started State Station Stone Storage Store Storm Stream Street Summer Sun Support System Table Test Third Time Tool Tower Town Trail Tree Upper User Valley Version View Village Wall Watch Water Wave West White Wild Wind Window Winter Wood Yellow Young
""".split())  # fmt: skip

#: Phrases around personal details; {N} a name, {E} an e-mail address, {P} a phone number, {I} an identity number, {A} an address.
WITH = """
Contact {N} at {E}.|Contact {N} at {E} or {P}|For details ask {N}.|I spoke with {N} yesterday.|We met {N} in Leeds.|{N} said the test had failed.|{N} wrote the first draft.|Patient {N} was seen on Monday.|CEO {N} signed the contract.|our engineer {N} will call you|Yours sincerely, {N}|Kind regards, {N}|Regards, {N}|Best wishes,\n{N}|Cheers\n{N}
Signed-off-by: {N} <{E}>|Co-authored-by: {N} <{E}>|Reviewed-by: {N}|Reported-by: {N} <{E}>|Tested-by: {N}|Author: {N}|author: {N} <{E}>|author = "{N}"|Authors: {N}, {N}|authors = ["{N} <{E}>"]|maintainer: {N}|Maintainer: {N} <{E}>|Copyright (c) 2019 {N}|Copyright 2004 by {N}|Thanks to {N} for the report.|Many thanks to {N} and {N}|Reported by {N}.|fixed by {N}|Fix suggested by {N} in review.|as {N} pointed out|as {N} noted|according to {N}|assigned to {N}|assignee: {N}|reviewer: {N}
Dear {N},|Dear {N}, the parcel has come back.|Hi {N},|Hello {N}!|Good morning {N},|cc: {N}|Cc {E}|bcc {E}|From: {N} <{E}>|To: {N}|Attn. {N}|c/o {N}, {A}|Name: {N}|Full name: {N}|Customer: {N}, {A}|Tenant {N} lives at {A}.|- {N} <{E}>|- {N} ({E})|* {N} ({E}) raised the limit|* {N}: release manager|{N}, {P}|{N}; {E}; {P}|{N} ({E}) joined the team.|ask {N} before merging|Meeting with {N} and {N}.|by {N}|written by {N}|patch by {N}.|Talk by {N}, then lunch.|an interview with {N}|my colleague {N}|the lawyer {N} and the judge {N}|{N} asked whether the pool drains.|Yesterday {N} called the office.|On Friday {N} wrote:|{N} replied:|, said {N}.|Passport {I} belongs to {N}.|holder {N}, no. {I}|holder: {N}|ID {I}, {N}|{N}, born 1970|signed: {N}|Witness: {N}|speaker: {N}|Signed {N}
Mail {E} for access.|e-mail: {E}|E-mail {E}|Email: {E}|Send it to {E}.|Reach us at {E} or {P}.|write to {E}|Questions go to {E}.|Questions? {E}|contact = "{E}"|user={E}|USER_EMAIL={E}|--mail-to {E}|invoices to {E}, copies to {A}|support address: {E}|{E}|<{E}>|my address is {E}
Phone: {P}|Phone {P}|Tel. {P}|Tel: {P}|tel {P}|Call {P} after six.|call {P}|Fax {P}|mobile {P}|Mobile: {P}|cell {P}|text me at {P}|hotline {P}|{P} (office hours)|reach me on {P}|pager {P}|SMS to {P}|my phone is {P}|phone number is {P}|WhatsApp {P}|ring {P}|dial {P}|--sms {P}|phone is {P}, ask for {N}|Emergency line: {P}|desk {P}|Give me a ring on {P}.
SSN {I}|SSN: {I}|SSN {I} was pasted into the log.|social security number {I}|her social security number is {I}|passport no. {I}|Passport number {I}|passport {I}|ID number: {I}|id no. {I}|national id {I}|The national id {I} was sent by mistake.|ID card {I}|identity card no. {I}|identity number {I}|proof of identity: {I}|The form shows {I} as her identity number.
The office is at {A}.|She lives at {A}.|Ship to {A}.|Ship the form to {A}|Address: {A}|Address {A}|Office: {A}|office: {A}; phone {P}|Deliver it to {A}|mail it to {A}|{A}|We moved to {A} in May.|copies to {A}|The parcel for {A} came back.|Send the letter to {N}, {A}|Headquarters: {A}|meet me at {A}|Return to: {A}
Merci à {N} pour le rapport.|Signalé par {N}.|corrigé par {N}|écrit par {N}|J'ai parlé avec {N} hier.|Le client {N} a appelé.|{N} a écrit la première version.|comme {N} l'a noté|comme l'a dit {N}|d'après {N}|Cher {N},|Chère {N},|Bonjour {N},|Cordialement, {N}|À l'attention de {N}|Nom : {N}|Auteur : {N}|Écrire à {E}.|Écrivez à {E} ou appelez le {P}.|Courriel : {E}|Tél. {P}|Téléphone : {P}|appelez le {P}|joignable au {P}|portable {P}|Adresse : {A}|J'habite {A}.|Le bureau se trouve {A}.|envoyer à {A}|numéro de sécurité sociale {I}|Numéro d'identité {I}|carte d'identité n° {I}|passeport {I}
Dank an {N} für den Bericht.|Gemeldet von {N}.|behoben von {N}|geschrieben von {N}|Ich sprach gestern mit {N}.|Der Kunde {N} hat angerufen.|Die Kollegin {N} prüft das.|{N} schrieb die erste Fassung.|wie {N} anmerkte|wie {N} bemerkte|laut {N}|Lieber {N},|Liebe {N},|Hallo {N},|Sehr geehrter {N},|Sehr geehrte {N},|Mit freundlichen Grüßen\n{N}|Viele Grüße, {N}|zu Händen {N}|Name: {N}|Autor: {N}|Bitte an {E} schreiben.|Bitte schreiben Sie an {E} oder rufen Sie {P} an.|E-Mail: {E}|Telefon {P}|Telefon: {P}|Tel. {P}|Handy {P}|Rückruf unter {P}|erreichbar unter {P}|Anschrift: {A}|Adresse: {A}|Sie wohnt {A}.|Das Büro liegt in der {A}.|Lieferung an {A}|Ausweisnummer {I}|Personalausweis {I}|Reisepass {I}|Passnummer {I}|Sozialversicherungsnummer {I}
Gracias a {N} por el informe.|Informado por {N}.|corregido por {N}|escrito por {N}|Ayer hablé con {N}.|El cliente {N} llamó.|La doctora {N} firmó.|{N} escribió la primera versión.|como señaló {N}|como dijo {N}|según {N}|Estimado {N},|Estimada {N},|Hola {N},|Querida {N},|Saludos, {N}|Atentamente, {N}|A la atención de {N}|Nombre: {N}|Autor: {N}|Escriba a {E}.|Escriba a {E} o llame al {P}.|Correo: {E}|Tel. {P}|Teléfono: {P}|llame al {P}|móvil {P}|Dirección: {A}|Vive en {A}.|La oficina está en {A}.|enviar a {A}|DNI {I}|NIE {I}|NIF {I}|pasaporte {I}|número de identidad {I}
"""  # fmt: skip
#: Phrases that only look alike; {W} an invented product, {T} a thing of ordinary words, {w} a word, {U} one in capitals, {d} a number, {B} {D} {V} {H} {Z} codes, dates, versions, hashes and grouped digits, {S} a street name without a number.
WITHOUT = """
the {W} {W} server|The {W} {W} scheduler starts at boot.|The {T} scheduler was renamed to {T}.|See the {T} of {W}.|See page {d}, table 3, of the {W} Handbook.|Read the {W} {T} first.|Released on {D} as {w} 2.0.|Build {B} was promoted.|build {B}|Ports {Z} stay closed.|ports {d4}-{d4} are open|Checksum {Z} failed.|checksum block {d4} {d4} failed in the {T} sample|Listening on 10.0.0.{d}:{d4}.|bound to 192.168.1.{d}|Pin {w}@{V} in the lockfile.|The decorator @{w} takes no arguments.|Use @{w} on {W}.|npm install {w}@{V}|Set {W} to {d} so that the {w} can lock.|Whenever {W} polls a {w}, it follows.|Both {W} and {W} share one queue.|Version {V} of {W} caches the linker.|Since release {V} the pool of {W} no longer locks.|Changed {W} to resolve the {w}.|Neither the {w} nor the queue of {W} can retry.|Support for {W} was added in {V}.|A log of {W} shows {d} lines.|{W} writes the log on start.|It was written by {W} {W} on start.|Explain why {W} reorders the queue.|Suppose {W} holds {d} entries.|According to the {W} manual, {W} polls.|According to {W} {T}, it polls.|Removed the pool, use {W} {T} instead.|Thanks to {W} {T} it is fast.|Reported by {W} {T} at boot.
Commit {H} fixes {d4} cases.|commit {H}|sha {H} at {V}|It took {d} seconds for {W} to start. {W} {T}|{W} {W} drains the pool.|In {W} {T} mode the pool waits.|Order {B} shipped on {D}.|order no. {B}|ticket {Z}|invoice {B}|serial {B}|ISBN 978-{Z}|{D} {d4}|{D} 12:30:45 {w}|at {D}T10:15:00|took {d4}{d4} ms|{d4} {d4} {d4} rows|id={d4}{d4}|error {d4}-{d4}|timeout {d} s|{d4}.{d4} of {d4}.{d4}|memory {d4} {d4} kB|Table {d} lists {W} and {T}.|{T}|{T} of {T}|Quick Start|Getting Started|Release Notes {V}|What Is New In {W}|Installing {W} On {W}|The {S} sample|the {S} view was renamed|See {S} for a picture.|{d} {w} on {W} Street View
{U} {U} ALREADY ROTATES ONE {U}.|GIVEN {d} UNITS IN {U}, HOW MANY DOES {U} CANCEL?|THE {U} {U} MANUAL|THE {U} OF {U} WAITS FOR {U} AND {U}|WARNING: {U} {U} FAILED|{U}, {U} AND {U}|SEE {U} {U}|BY {U} ON STARTUP|TODO FIXME {U}|DO NOT EDIT|README FIRST|{F} {W} drains the pool.|{F} {W} {V} reads it.|{F} {W}, {W} and others drain it.|{F} {T} waits.|* {F} {W} caches {d} lines.|- {F} {W}|* {W} {W}: reads {w}|- {W} {T}|{W} {W} and {W} {W} are two modes.|{W}, {W} and {W}|{W}, {T}|Parsed {W}, {W}.|Name: {W} {T}|Author tools: {W} {T}|by {W}|From {W} to {W}|To {W}|From {W} {V} on
Wenn {W} scheitert, bleibt der Puffer.|Bitte {W} nicht aufrufen.|Ab {V} ersetzt {W} den Puffer.|Die Option {w} sorgt dafür, dass {W} wartet.|Ein Fehler in {W} führte dazu.|Der Dienst {W} liest {W} {T}.|Das Modul {W} {W} wurde entfernt.|Seit Version {V} liest {W} mit.|Siehe Seite {d} im {W} Handbuch.|Im Kapitel {d} steht {W}.|{F} {W} {V} liest.|{F} {W} wartet.|* {F} {W} {V} liest {w}.|Die Datei {W} Liste Eintrag|Neue Fassung vom {D}|Bauteil {B}
Quand {W} échoue, le tampon reste.|Depuis la version {V}, {W} relit.|Le réglage permet à {W} de garder un index.|Le module {W} {W} a été retiré.|Voir la page {d} du manuel {W}.|Chaque {W} relit {W}.|{F} {W} échoue.|{F} {W} {V} attend.|Version {V} du {D}|Commande {B}|La file de {W} {T}
Cuando {W} falla, el canal se cierra.|Desde la versión {V}, {W} vuelve a leer.|Medimos {W} con {d} entradas.|El módulo {W} {W} fue retirado.|Véase la página {d} del manual {W}.|Cada {W} relee {W}.|{F} {W} falla.|{F} {W} {V} espera.|Versión {V} del {D}|Pedido {B}|La cola de {W} {T}
"""  # fmt: skip
#: Phrases that fit a person and a thing; {X} is a name told as such elsewhere in the text, or a thing.
EITHER = """
{X} raised the limit.|{X} was restarted.|{X} stopped again.|Then {X} stopped.|see {X}|with {X} and the rest|{X} waits.|{X} is back.|{X}, version 2|the limit stays at {X}|and {X} again|after that, {X}|{X} has no more time.|{X}|depends on {X}|more about {X} below|seit {X} da ist|mit {X} und dem Rest|{X} wartet.|avec {X} et le reste|{X} attend.|con {X} y lo demás|{X} espera.|SEE {X} AGAIN|The note names {X}.|{X} again
"""
#: Words that often begin a sentence.
OPENERS = "The A An In On At By For From With Without When While Whenever If Since Until Unless Each Every Both Neither Either Set Use Read Keep Avoid Changed Removed Added Fixed Please See Version Release Support Users Our This That These It After Before During Then And But Where Why How Der Die Das Den Dem Des Ein Eine Einen Seit Wenn Ab Bitte Für Vor Nach Bei Mit Ohne Jeder Jede Jedes Im Am Und Oder Aber Dann Le La Les Un Une Des Du Quand Depuis Si Pour Chaque Avec Sans Il Elle Nous Et Ou Mais El Los Las Una Uno Cuando Desde Para Con Sin Cada Medimos Se Al Del En Como Y Pero".split()
STREETS = "Street St Road Rd Lane Ln Avenue Ave Terrace Drive Dr Way Court Ct Square Sq Place Pl Boulevard Blvd Close Crescent Row Hill Walk Gardens Parkway Highway Mews Grove".split()


def _phrases(text: str) -> list[str]:
    return [p for line in text.strip("\n").split("\n") for p in line.replace("\\n", "\n").split("|")]


class Maker:
    """Texts with known personal spans, and without."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.personal, self.plain, self.either = _phrases(WITH), _phrases(WITHOUT), _phrases(EITHER)
        self.given, self.common = sorted(GIVEN), sorted(COMMON)

    def word(self, low: int = 2, high: int = 4) -> str:
        r = self.r
        return "".join(r.choice("b c d f g h j k l m n p r s t v w z br dr tr st sk th".split()) + r.choice("aeiou") for _ in range(r.randint(low, high))) + r.choice(["", "n", "r", "s", "l", "nd", "rt", "ski", "z"])

    def cap(self, low: int = 2, high: int = 4) -> str:
        """An invented name of a person or a thing, both of one kind, so that only words around it tell."""
        w = self.word(low, high).capitalize()
        return w.replace("o", "ö").replace("e", "é") if self.r.random() < 0.08 else w

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def name(self) -> str:
        r = self.r
        first = r.choice(self.given) if r.random() < 0.4 else self.cap(1, 3)
        last = self.cap(1, 4)
        if r.random() < 0.08:
            last += "-" + self.cap(1, 2)
        if r.random() < 0.06:
            last = r.choice(["van ", "von ", "de ", "van der ", "de la ", "O'", "Mc"]) + last
        form = r.random()
        title = r.choice(["Mr", "Mr.", "Ms", "Ms.", "Mrs.", "Miss", "Dr.", "Dr", "Prof.", "Professor", "M.", "Mme", "Mlle", "Herr", "Frau", "Sr.", "Sra.", "Señor", "Señora", "señor", "señora", "monsieur", "madame", "Professor", "professor", "doctor"])
        full = f"{first} {last}" if form < 0.48 else f"{first} {r.choice('ABCDEFGHJKLM')}. {last}" if form < 0.58 else f"{last}, {first}" if form < 0.7 else f"{title} {last}" if form < 0.84 else f"{title} {first} {last}" if form < 0.88 else f"{first} {self.cap(1, 3)} {last}" if form < 0.91 else f"{first} {last}"
        return full if form < 0.91 else full.upper()

    def thing(self) -> str:
        r = self.r
        ordinary = lambda: r.choice(self.common)
        return r.choice([lambda: f"{ordinary()} {ordinary()}", lambda: f"{self.cap(2, 4)} {ordinary()}", lambda: f"{ordinary()} {self.cap(2, 4)}", ordinary])()

    def email(self) -> str:
        r, a, b = self.r, self.word(1, 3), self.word(2, 3)
        c = r.choice(["example", "org", "com", "test", "net", "de", "fr", "es", "co.uk"])
        local = r.choice([a, f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a}{self.digits(2)}", f"{a}+lists"])
        return r.choice([f"{local}@{b}.{c}", f"<{local}@{b}.{c}>", f"mailto:{local}@{b}.{c}", f"{a} [at] {b} [dot] {c}", f"{a} (at) {b}.{c}", f"{a} at {b} dot {c}", f"{local}@MAIL.{b.upper()}.{c.upper()}"])

    def fill(self, pattern: str) -> str:
        return "".join(self.digits(1) if c == "9" else c for c in pattern)

    def phone(self) -> str:
        """Public numbering formats of several countries."""
        return self.fill(self.r.choice(["+44 20 9999 9999", "+44 9999 999999", "020 9999 9999", "+49 30 99999 999", "+49 999 9999999", "030/99999-999", "0999/999999", "089 9999 9999", "+33 1 99 99 99 99", "+33 6 99 99 99 99", "01 99 99 99 99", "01.99.99.99.99", "06 99 99 99 99", "+34 999 999 999", "999 999 999", "+1 999 999 9999", "+1 999 9999 999", "+1-999-999-9999", "+1 (999) 999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "0033999 999999", "0049 99 9999999", "0044 20 99999999", "+999999999999", "+99999999999"]))

    def identity(self) -> str:
        """Public formats: US and French social security, Spanish DNI and NIE, German tax number and identity card, passports."""
        r = self.r
        letter = r.choice("ABCDEFGHJKLMNPRSTVWXYZ")
        return self.fill(r.choice(["999-99-9999", "999 99 9999", "99999999" + letter, "99999999-" + letter, "99.999.999-" + letter, r.choice("XYZ") + "9999999" + letter, r.choice("XYZ") + "-9999999-" + letter, "1 99 99 99 999 999 99", "2 99 99 99 999 999 99", "199999999999999", "299 9999 999 99999", "99 999 999 999", "99999999999", "99 999999 " + letter + " 999", "999999999", r.choice("ABCLMP") + "9999999", r.choice("CFGHJK") + "99999999"]))

    def address(self) -> str:
        r, w = self.r, self.cap(2, 3)
        city, zip_, n = self.cap(2, 3), self.digits(5), str(r.randint(1, 240))
        kind = r.choice(STREETS)
        return r.choice([f"{n} {w} {kind}, {city}", f"{n} {w} {kind}", f"{n} {w} {kind}, {city} {zip_}", f"{n} {r.choice(self.common)} {w} {kind}", f"Flat {r.randint(1, 40)}, {n} {w} {kind}, {city}", f"P.O. Box {self.digits(4)}, {city}", f"PO Box {self.digits(3)}", f"{n}, {r.choice(['rue', 'avenue', 'impasse', 'place', 'boulevard'])} {r.choice(['', 'de ', 'du ', 'de la '])}{w}, {zip_} {city}", f"{n} rue {w}", f"{w}{r.choice(['straße', 'strasse', 'weg', 'platz', 'gasse', 'allee'])} {n}, {zip_} {city}", f"{w}straße {n}", f"{r.choice(['Calle', 'Avda.', 'Avenida', 'Plaza', 'Paseo'])} {r.choice(['', 'de '])}{w} {n}, {zip_} {city}", f"Calle {w}, {n}", f"Postfach {self.digits(4)}, {zip_} {city}", f"Boîte postale {self.digits(3)}, {city}", f"Apartado {self.digits(4)}, {city}"])

    def filled(self, phrase: str, fixed: dict[str, str] | None = None) -> tuple[str, list[tuple[int, int, int]]]:
        """A phrase with its slots filled, and (start, end, label) of what is personal."""
        r, spans, out = self.r, [], ""
        for piece in re.split(r"(\{\w+\})", phrase):
            slot = piece[1:-1] if piece[:1] == "{" else None
            made = (fixed or {}).get(slot) or {
                None: lambda: piece, "N": self.name, "E": self.email, "P": self.phone, "I": self.identity, "A": self.address, "W": lambda: self.cap(1, 4), "w": lambda: self.word(2, 4), "U": lambda: self.word(2, 4).upper(), "F": lambda: r.choice(OPENERS), "T": self.thing, "d": lambda: self.digits(r.randint(1, 4)), "d4": lambda: self.digits(4),
                "D": lambda: f"20{self.digits(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", "V": lambda: f"{r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(0, 30)}", "B": lambda: self.fill(r.choice(["9999-99-9999999", "9999999", "99-9999", "9999/9999", "99999-9"])), "H": lambda: f"{r.getrandbits(40):x}", "Z": lambda: self.fill(r.choice(["9999 9999", "9999-9999", "99999 99999", "999 999", "99-99-99", "9999 9999 9999"])), "S": lambda: f"{self.cap(2, 3)} {r.choice(STREETS)}",
                "X": lambda: f"{self.cap(1, 3)} {self.cap(1, 4)}",
            }[slot]()
            if slot in ("N", "E", "P", "I", "A"):
                spans.append((len(out), len(out) + len(made), {"E": 1, "P": 2, "I": 3, "A": 4, "N": 5}[slot]))
            out += made
        return out, spans

    def sentence(self, personal: bool) -> tuple[str, list[tuple[int, int, int]]]:
        return self.filled(self.r.choice(self.personal if personal else self.plain))

    def text(self) -> tuple[str, list[tuple[int, int, int]]]:
        """Two or three sentences; in half of the texts one name or thing again, once clear and once or twice where either could stand."""
        r = self.r
        parts = [self.sentence(r.random() < 0.5) for _ in range(r.choice([1, 2, 2]))]
        if r.random() < 0.5:
            person = r.random() < 0.5
            x = f"{self.cap(1, 3)} {self.cap(1, 4)}"
            clear = r.choice([p for p in self.personal if "{N}" in p] if person else [p for p in self.plain if "{W} {W}" in p])
            clear = clear.replace("{N}", "{X}", 1) if person else clear.replace("{W} {W}", "{X}", 1)
            for phrase in [clear, *[r.choice(self.either) for _ in range(r.choice([1, 1, 2]))]]:
                body, spans = self.filled(phrase, {"X": x})
                if person:
                    at = body.find(x)
                    spans = sorted([*spans, (at, at + len(x), 5)])
                parts.append((body, spans))
            r.shuffle(parts)
        text, gold = "", []
        for k, (body, spans) in enumerate(parts):
            joint = r.choice([" ", "\n", "\n"]) if k else ""
            gold += [(a + len(text) + len(joint), z + len(text) + len(joint), y) for a, z, y in spans]
            text += joint + body
        if r.random() < 0.1:
            text = "".join(c.upper() if len(c.upper()) == 1 else c for c in text)
        return text, gold
