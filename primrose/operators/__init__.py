"""DataFrame operators, by subject.

``rank``      exact global positions and running sums
``messages``  capture rules, links, crawl results, size accounting
``feeds``     feed items against the article store
``validity``  usable and unusable articles
``ratings``   rating slots and rating statistics
``annotate``  annotation batches
``split``     train/test split and snapshots
``corpus``    corpus statistics
``features``  document features and bigram selection
``models``    learning
``logistic``  penalised logistic regression on distributed features
``trees``     decision trees, level by level
``metrics``   prediction quality
"""
