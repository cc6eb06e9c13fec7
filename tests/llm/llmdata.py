DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF01 = "/root/testdata/sf0.01"
