"""Ordinary text in four languages, written by hand for the tests: ⟦n…⟧ a name, ⟦e…⟧ e-mail, ⟦p…⟧ phone, ⟦i…⟧ id number, ⟦a…⟧ address."""

from __future__ import annotations

import re

KINDS = {"n": "name", "e": "email", "p": "phone", "i": "id_number", "a": "address"}

MARKED = [
    "Please contact ⟦nRajesh Kumar⟧ about it.", "I met Dr. ⟦nEmily Carter⟧ yesterday and she agreed.", "Reviewed by ⟦nLi Wu⟧ and ⟦nThomas Ekström⟧.", "My colleague ⟦nHannah Whitfield⟧ will take over on Monday.",
    "Ask ⟦nPriya Patel⟧ for the password rotation.", "According to ⟦nMargaret O'Sullivan⟧, the release slips a week.", "⟦nJohn Smith⟧ wrote the first draft of this parser.", "Thanks, ⟦nDaniel⟧! That fixed the build.",
    "Dear Mrs ⟦nHarrington⟧, your ticket was closed.", "The pull request from ⟦nOliver J. Bennett⟧ breaks the tests.", "Signed-off-by: ⟦nGrace Hopwood⟧ <⟦egrace.hopwood@example.org⟧>", "Call ⟦nSamuel Okafor⟧ at ⟦p+1 415-555-0132⟧ if the pager fails.",
    "We paired with ⟦nCaroline Fletcher⟧ and ⟦nPeter van der Berg⟧ on the migration.", "It was Mr. ⟦nWallace⟧ who found the leak.", "Meeting notes by ⟦nAmy Thornton⟧: nothing new.", "Hello ⟦nSarah⟧, could you rerun the job?",
    "Send the invoice to ⟦ebilling+2024@acme-tools.co.uk⟧ please.", "My address is ⟦ejane_doe@mail.example.com⟧, write any time.", "Reach me at ⟦efirst.last [at] example [dot] com⟧ after lunch.", "The mailbox ⟦eops-team@status.internal.example⟧ is full.",
    "Contact: ⟦ekurt.meyer@firma.example⟧; phone ⟦p+49 30 901820⟧.", "Escriba a ⟦esoporte@tienda.example⟧ o llame al ⟦p+34 912 345 678⟧.", "Écrivez à ⟦econtact@mairie.example⟧ ou appelez le ⟦p01 42 68 53 00⟧.", "Forward it to ⟦ehr@example.net⟧ and ⟦elegal@example.net⟧.",
    "The office number is ⟦p(212) 555-0187⟧, ask for the night desk.", "Text ⟦p+44 20 7946 0958⟧ when you arrive.", "Phone ⟦p415-555-0199⟧ or fax.", "Tel. ⟦p+33 6 12 34 56 78⟧ jour et nuit.", "Rufen Sie ⟦p0171 2345678⟧ an.", "Mi móvil es ⟦p612 345 678⟧, gracias.",
    "Hotline ⟦p+1 (800) 555-0144⟧ is open.", "Mobil: ⟦p+49 171 9876543⟧", "Ring ⟦p020 7946 0123⟧ before noon.", "Numéro: ⟦p06 98 76 54 32⟧.", "Teléfono ⟦p+34 600 123 456⟧.",
    "Her SSN is ⟦i078-05-1120⟧ and must not be logged.", "The row holds social security number ⟦i219-09-9999⟧.", "Su DNI es ⟦i12345678Z⟧ según el registro.", "El NIE ⟦iX1234567L⟧ ha caducado.", "N° de sécurité sociale ⟦i1 84 12 76 451 089 46⟧ à effacer.",
    "Steuer-ID ⟦i86 095 742 719⟧ bitte schwärzen.", "National id: ⟦i536-22-1234⟧.", "DNI ⟦i87.654.321-X⟧", "Steuernummer im Log: Steuer-ID ⟦i47 036 892 816⟧.", "insee ⟦i2 69 05 49 588 157 80⟧",
    "She lives at ⟦a221 Baker Street⟧, above the shop.", "Ship it to ⟦a1600 Amphitheatre Parkway, Mountain View, CA 94043⟧.", "The venue is ⟦a45 West Lake Ave⟧.", "Deliver to ⟦a742 Evergreen Terrace, Apt 3B⟧ please.", "Rendez-vous au ⟦a12 rue Victor Hugo, 75001 Paris⟧.",
    "Il habite ⟦a8 bis, avenue de la République, 69003 Lyon⟧ depuis mai.", "Adresse: ⟦a5 place du Marché, 67000 Strasbourg⟧", "Die Firma sitzt in der ⟦aHauptstraße 12, 10115 Berlin⟧.", "Lieferung an ⟦aLindenweg 7a, 80331 München⟧ bitte.", "Er wohnt ⟦aAm Markt 3, 28195 Bremen⟧.",
    "Vive en ⟦aCalle Mayor 15, 28013 Madrid⟧ con su madre.", "La tienda está en ⟦aAvenida de América 24, 28028 Madrid⟧.", "Entrega en ⟦aPlaza del Sol 2, 3º B, 46001 Valencia⟧.", "Old place: ⟦a9 Elm Rd⟧.", "Visit ⟦a350 Fifth Avenue, New York, NY 10118⟧ today.",
    "Bonjour ⟦nCamille⟧, le rapport est prêt.", "Merci à ⟦nJean-Pierre Lambert⟧ pour la relecture.", "Le correctif vient de ⟦nSophie Marchand⟧.", "Selon Mme ⟦nDubois⟧, il faut attendre.", "⟦nFrançois Lefèvre⟧ a signalé le problème.", "J'ai vu ⟦nChloé Moreau⟧ hier matin.",
    "Monsieur ⟦nPaul Girard⟧ est absent cette semaine.", "Demandez à ⟦nNicolas Petit⟧ de valider.", "Il faut prévenir ⟦nClaire Fontaine⟧ avant midi.", "Voir avec ⟦nMichel Rousseau⟧ (⟦emichel.rousseau@example.fr⟧).",
    "Hallo ⟦nStefan⟧, der Fehler ist behoben.", "Frau ⟦nSchneider⟧ prüft das Protokoll.", "Der Patch stammt von ⟦nJürgen Hoffmann⟧.", "⟦nKatharina Vogel⟧ hat den Test geschrieben.", "Bitte ⟦nKlaus Becker⟧ fragen.", "Ich habe mit ⟦nLena Fischer⟧ gesprochen.",
    "Danke, ⟦nMatthias⟧, das hilft.", "Laut Herrn ⟦nBraun⟧ ist das Absicht.", "Der Entwurf ist von ⟦nHans von Bergen⟧.", "Melden Sie sich bei ⟦nSabine Krüger⟧, Tel. ⟦p030 1234567⟧.",
    "Hola ⟦nCarlos⟧, ya está arreglado.", "Hablé con ⟦nMaría Fernández⟧ ayer.", "Según la señora ⟦nGutiérrez⟧, falta una copia.", "El cambio lo hizo ⟦nJavier Ortega Ruiz⟧.", "⟦nLucía Navarro⟧ revisará el código.", "Gracias, ⟦nPedro⟧, funciona.",
    "Hay que llamar a ⟦nAntonio Romero⟧.", "Pregunte a ⟦nElena Castillo⟧ por la clave.", "Lo escribió ⟦nDiego Morales⟧ el lunes.", "Envíelo a ⟦nRosa Jiménez⟧ (⟦erosa.jimenez@example.es⟧).",
]
#: Nothing of this is anyone's.
PLAIN = [
    "Run the Docker container on Friday and check the New York region.", "The Python interpreter raised ValueError in UserService.load().", "Error 404 at line 1234 of build 20240131.", "Version 3.12.4 of the package needs 2048 MB.", "Open the Weekly Report and click Export.",
    "La fonction renvoie Null si la Liste est vide.", "Der Server startet am Montag um 12:30 Uhr.", "El archivo README.md está vacío desde enero.", "TODO: rename FooBar to BarFoo in src/main.py:120.", "Commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b is broken.",
    "The Jenkins job took 1200 ms; see Figure 3.", "Use offset 415 and stride 5550132 for shape (3, 4).", "INFO [main] Started Application in 3.2 seconds", "Google and Microsoft published the Rust guide.", "She said no, and he went home.",
]


def unmarked(text: str) -> tuple[str, set[tuple[int, int, str]]]:
    out, mentions = "", set()
    for part in re.split(r"(⟦[nepia][^⟧]*⟧)", text):
        if part.startswith("⟦"):
            mentions.add((len(out), len(out) + len(part) - 3, KINDS[part[1]]))
            part = part[2:-1]
        out += part
    return out, mentions
