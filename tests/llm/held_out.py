"""Sentences with personal details and without, written apart from the phrases the field is trained on: other words around the details, and
names, numbers and streets of the ordinary kind."""

NAMES = """
My neighbour Hannah Weiss has a key.|Yesterday Peter Hansen resigned.|The keynote is given by Priya Raman.|Maria Lopez will cover the night shift.|Could you forward this to Oliver Brandt?|The minutes were taken by Ruth Feldman.|We hired Samuel Okafor last spring.|Nurse Joan Whitfield noticed the error first.|Please page Dr. Lindqvist at once.|Prof. Ellen Marsh reviewed the paper.
The flat belongs to Mrs. Abernathy.|CEO Linda Park stepped down.|Patient John Carter was discharged.|Ask Maria Lopez about the keys.|My sister Clara Novak paints.|In the photo: Thomas Reed, second from left.|Tickets are held for Victor Hale.|I owe Martin Frost twenty pounds.|Committed on behalf of Sarah Whitman.|Credit for the idea belongs to Daniel Osei.
Meine Nachbarin Hannah Weiss hat einen Schlüssel.|Der Kunde Thomas Müller zahlt bar.|Gestern kündigte Petra Vogel.|Den Vortrag hält Jürgen Albrecht.|Das Protokoll führte Sabine Kern.|Bitte leiten Sie das an Klaus Winter weiter.|Frau Schneider hat Urlaub.|Herr Doktor Baumann kommt später.|Zeuge Karl Hofmann sah den Wagen.|Die Wohnung gehört Ursula Bergmann.
Ma voisine Claire Fontaine a une clé.|Hier, Julien Moreau a démissionné.|Le compte rendu est de Sophie Lambert.|Pouvez-vous transmettre à Nicolas Perrin ?|Mme Girard est absente.|Le docteur Antoine Mercier viendra demain.|L'appartement appartient à Louise Garnier.|Nous avons recruté Pierre Vasseur au printemps.|La conférence de Camille Rousseau est pleine.|Monsieur Lefèvre a payé.
Mi vecina Lucía Romero tiene una llave.|Ayer dimitió Javier Ortega.|La ponencia la da Carmen Vidal.|El acta es de Sergio Molina.|¿Puede reenviar esto a Elena Castro?|La señora Navarro está de vacaciones.|El piso pertenece a Rosa Delgado.|Contratamos a Pablo Herrera en primavera.|El testigo Diego Fuentes vio el coche.|El señor Ibáñez pagó.
""".strip().replace("\n", "|").split("|")
EMAILS = """
Drop a line to kate.morris@quarry.example whenever you like.|Invoices: billing+2024@shop.example.org|log in as root-admin@db.internal.example.net|You can find me under tim (at) meadow (dot) org.|reply-to=<office@verein.example.de>|Man erreicht uns über info@werkstatt.example.de.|Il suffit d'écrire à secretariat@mairie.example.fr avant midi.|Mande el justificante a cobros@tienda.example.es.|The list moved to dev [at] lists.example.com.|a_b-c.d@x-y.example.co.uk bounced
""".strip().replace("\n", "|").split("|")
PHONES = """
You can get hold of us on 020 7946 0123 until noon.|If the alarm goes off, ring +44 1632 960983.|Front desk: (212) 555-0147|Text STOP to 555-010-9988 to leave.|Our number is +1-202-555-0173.|Der Notdienst hat die 030 5550 1234.|Unter +49 89 5550 1122 meldet sich niemand.|Mein Handy: 0171/5550123|Le standard est au 01 55 50 12 34.|Joignez-moi au +33 6 55 50 12 34.|El fijo es 915 550 123.|Deje un mensaje en el +34 655 501 234.
""".strip().replace("\n", "|").split("|")
IDENTITIES = """
Her SSN is 078-05-1120.|The applicant's social security number reads 219 09 9999.|Travels on passport C01X00T47 and L8988901.|Passport number: 533380006|Seine Ausweisnummer lautet 00 123 456 789.|Im Personalausweis steht 12 345 678 901.|Son numéro de sécurité sociale : 2 84 05 88 888 888 55|Numéro INSEE 1 85 07 75 123 456 78|Su DNI es 12345678Z.|Con NIE X1234567L firmó el contrato.
""".strip().replace("\n", "|").split("|")
ADDRESSES = """
The shop moved to 48 Harbour Street, Whitby.|They rent Flat 3, 19 Maple Avenue, Leeds 40213.|Letters go to P.O. Box 771, Dover.|Come round to 7 Rose Lane.|Der Laden ist jetzt in der Bahnhofstraße 12, 80335 München.|Post bitte an Postfach 1203, 50667 Köln.|Sie zog in den Lindenweg 4.|La boutique est au 12, rue de la Paix, 75002 Paris.|Ils louent 3 avenue Foch.|La tienda está en la Calle Mayor 21, 28013 Madrid.|Viven en Plaza de España, 4.|Apartado 305, Sevilla
""".strip().replace("\n", "|").split("|")
HARMLESS = """
The Night Watch release ships on Friday.|Open Street Map tiles are cached.|Table 4 lists North Sea ports.|Upgrade from 2.3.11 to 3.0.0 first.|The job ran for 1200 3400 ticks.|Use Visual Basic or Pascal.|Ticket 2024-1187 was closed.|Port range 8000-8010 is free.|It listens on 172.16.0.12:8443.|Commit 9fceb02d0ae5 reverted it.|See Chapter Nine of the User Guide.|Black Forest cake needs eight eggs.|Silicon Valley firms agree.|Green Tea and White Rice|The Old Mill is closed.|Order 4500018832 left the dock.|The value 3.1415926535 is rounded.|2021-09-30 08:15:22 INFO started
Die Blaue Stunde beginnt um sechs.|Das Rote Kreuz hilft.|Die Deutsche Bahn ist zu spät.|Siehe Kapitel Drei im Handbuch.|La Tour Eiffel est fermée.|Le Monde paraît le soir.|Les Pays Bas ont gagné.|La Sagrada Familia abre a las nueve.|El Corte Nuevo cierra tarde.|Los Angeles queda lejos.|npm i left-pad@1.3.0|@Override marks the method.|ISBN 978-3-16-148410-0|width=1920 height=1080|EXIT CODE 137 MEANS KILLED|READ THE MANUAL FIRST
""".strip().replace("\n", "|").split("|")
