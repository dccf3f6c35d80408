"""Published models of two public loan-application logs.

Fixed values: the places kept, the directly-follows counts between their
activities, and every precise edge of the model with gateways shown as their
kind. `expanded` is the number of edges before simplification.
"""

LOG1 = {
    "places": [
        ({"O_Created"}, {"O_Sent_mail_and_online"}),
        ({"A_Concept"}, {"A_Accepted"}),
        ({"A_Create_Application"}, {"A_Concept"}),
        ({"O_Accepted"}, {"A_Pending"}),
        ({"O_Create_Offer"}, {"O_Created"}),
        ({"O_Created"}, {"O_Sent_mail_and_online", "W_Shortened_completion_"}),
        ({"O_Created"}, {"O_Sent_mail_and_online", "O_Sent_online_only", "W_Shortened_completion_"}),
        ({"O_Created"}, {"O_Sent_mail_and_online", "O_Sent_online_only"}),
        ({"A_Concept"}, {"W_Shortened_completion_", "A_Accepted"}),
        ({"W_Shortened_completion_", "A_Concept"}, {"A_Accepted"}),
        ({"O_Created", "W_Shortened_completion_"}, {"O_Sent_mail_and_online"}),
        ({"O_Created", "O_Sent_online_only", "W_Shortened_completion_"}, {"O_Sent_mail_and_online"}),
        ({"O_Created", "O_Sent_online_only"}, {"O_Sent_mail_and_online"}),
    ],
    "arcs": [
        ("A_Concept", "A_Accepted", 9231),
        ("A_Concept", "W_Complete_application", 22264),
        ("A_Concept", "W_Shortened_completion_", 14),
        ("A_Create_Application", "A_Concept", 3389),
        ("A_Create_Application", "A_Submitted", 20423),
        ("O_Accepted", "A_Pending", 17228),
        ("O_Create_Offer", "O_Created", 42995),
        ("O_Created", "O_Sent_mail_and_online", 35604),
        ("O_Created", "O_Sent_online_only", 1895),
        ("O_Created", "W_Shortened_completion_", 3),
        ("O_Sent_online_only", "O_Sent_mail_and_online", 1),
        ("O_Sent_online_only", "O_Sent_online_only", 85),
        ("W_Shortened_completion_", "A_Accepted", 29),
        ("W_Shortened_completion_", "O_Sent_mail_and_online", 2),
        ("W_Shortened_completion_", "W_Shortened_completion_", 116),
    ],
    "expanded": 50,
    "precise": [
        ("XOR", "AND", 35604),
        ("XOR", "AND", 3),
        ("O_Sent_online_only", "AND", 1),
        ("AND", "A_Accepted", 9260),
        ("A_Concept", "AND", 9245),
        ("XOR", "AND", 9260),
        ("AND", "O_Sent_mail_and_online", 35607),
        ("XOR", "AND", 14),
        ("XOR", "AND", 9231),
        ("AND", "XOR", 2),
        ("AND", "XOR", 2),
        ("AND", "XOR", 29),
        ("XOR", "AND", 35607),
        ("A_Create_Application", "A_Concept", 3389),
        ("AND", "XOR", 1),
        ("AND", "XOR", 1),
        ("AND", "XOR", 9245),
        ("AND", "XOR", 9231),
        ("AND", "AND", 9231),
        ("XOR", "AND", 35604),
        ("XOR", "AND", 1895),
        ("W_Shortened_completion_", "AND", 31),
        ("O_Created", "AND", 37502),
        ("XOR", "AND", 35604),
        ("XOR", "AND", 1895),
        ("XOR", "AND", 3),
        ("XOR", "AND", 35606),
        ("O_Accepted", "A_Pending", 17228),
        ("O_Create_Offer", "O_Created", 42995),
        ("AND", "W_Shortened_completion_", 17),
        ("AND", "XOR", 35604),
        ("AND", "XOR", 35604),
        ("AND", "AND", 35604),
        ("AND", "XOR", 35607),
        ("AND", "XOR", 35604),
        ("AND", "XOR", 37502),
        ("AND", "XOR", 37499),
        ("AND", "O_Sent_online_only", 1895),
        ("XOR", "AND", 35605),
    ],
}

LOG2 = {
    "places": [
        ({"O_Create_Offer"}, {"O_Created"}),
        ({"O_Created"}, {"O_Sent_mail_and_online"}),
        ({"O_Created"}, {"O_Sent_mail_and_online", "O_Sent_online_only"}),
    ],
    "arcs": [
        ("O_Create_Offer", "O_Created", 42995),
        ("O_Created", "O_Cancelled", 1203),
        ("O_Created", "O_Refused", 59),
        ("O_Created", "O_Sent_mail_and_online", 39707),
        ("O_Created", "O_Sent_online_only", 2026),
        ("O_Returned", "O_Accepted", 17228),
        ("O_Returned", "O_Cancelled", 2455),
        ("O_Returned", "O_Refused", 3573),
        ("O_Sent_mail_and_online", "O_Cancelled", 16365),
        ("O_Sent_mail_and_online", "O_Refused", 962),
        ("O_Sent_mail_and_online", "O_Returned", 22272),
        ("O_Sent_online_only", "O_Cancelled", 875),
        ("O_Sent_online_only", "O_Refused", 101),
        ("O_Sent_online_only", "O_Returned", 1033),
    ],
    "expanded": 12,
    "precise": [
        ("AND", "O_Sent_mail_and_online", 39707),
        ("O_Created", "AND", 41733),
        ("XOR", "AND", 39707),
        ("XOR", "O_Sent_online_only", 2026),
        ("O_Create_Offer", "O_Created", 42995),
        ("AND", "XOR", 41733),
        ("AND", "AND", 39707),
    ],
}
