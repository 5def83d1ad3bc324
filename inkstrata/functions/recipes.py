"""The built-in recipes: declarative word, phrase, regex and contextual patterns."""

from __future__ import annotations

# Words and what replaces them.
WORDS = {
    'accordingly': 'so',
    'additionally': 'also',
    'arguably': 'perhaps',
    'certainly': '',
    'consequently': 'so',
    'hence': 'so',
    'moreover': 'also',
    'nevertheless': 'still',
    'nonetheless': 'still',
    'notwithstanding': 'despite that',
    'thus': 'so',
    'undoubtedly': '',
    'adept': 'skilled',
    'commendable': 'good',
    'ever-evolving': 'changing',
    'exciting': 'interesting',
    'exemplary': 'strong',
    'invaluable': 'useful',
    'robust': 'sturdy',
    'seamless': 'smooth',
    'synergistic': 'cooperative',
    'thought-provoking': 'interesting',
    'transformative': 'significant',
    'utmost': 'most',
    'vibrant': 'lively',
    'vital': 'important',
    'innovative': 'new',
    'cutting-edge': 'advanced',
    'game-changing': 'significant',
    'pivotal': 'important',
    'comprehensive': 'thorough',
    'ergonomic': 'comfortable',
    'innovation': 'novelty',
    'tapestry': 'mix',
    'realm': 'area',
    'landscape': 'space',
    'aligns': 'matches',
    'augment': 'add',
    'delve': 'explore',
    'embark': 'start',
    'facilitate': 'help',
    'leverage': 'use',
    'maximize': 'increase',
    'underscores': 'highlights',
    'utilize': 'use',
    'harness': 'use',
    'illuminate': 'explain',
    'revolutionize': 'transform',
    'bolster': 'support',
    'streamline': 'simplify',
    'leveraging': 'using',
}

# Phrases of the vocabulary recipe and what replaces them.
PHRASES = {
    "it's important to note": 'note that',
    "it's important to consider": 'consider',
    "it's worth noting that": 'note:',
    'on the contrary': 'however',
    'that being said': 'but',
    'at its core': 'fundamentally',
    'to put it simply': 'simply',
    'generally speaking': 'usually',
    'broadly speaking': 'generally',
    'to some extent': 'partially',
    'from a broader perspective': '',
    'a testament to': 'shows',
    'in summary': '',
    'in conclusion': '',
    'this underscores the importance of': 'this shows',
    'a key takeaway is': 'notably',
    'shed light on': 'explain',
    'sheds light on': 'explains',
    'seamless integration': 'integration',
    'scalable solution': 'solution',
    'actionable insights': 'insights',
    'data-driven insights': 'analysis',
    'data-driven decisions': 'decisions',
    'under the hood': 'internally',
    'out of the box': 'by default',
    'at the end of the day': 'ultimately',
    'ready for production': 'production-ready',
    'as mentioned above': '',
    'for the sake of': 'for',
    'in order to': 'to',
    'provides a streamlined': 'provides',
}

# Phrases of the phrase recipe: severity (of the item, else of the group) and what replaces them.
TURNS = {
    "Let's break this down": ('high', None),
    'Let me break this down': ('high', None),
    "Here's a breakdown": ('high', None),
    "I'll walk you through": ('high', None),
    "Let's walk through": ('high', None),
    "Let's dive into": ('high', None),
    "Let's explore": ('medium', None),
    'Great question!': ('high', None),
    "That's a great question": ('high', None),
    'Excellent question': ('high', None),
    'Happy to help': ('high', None),
    "I'd be happy to": ('medium', None),
    'I hope this helps': ('high', None),
    'Hope this helps': ('high', None),
    'Feel free to': ('low', None),
    "Don't hesitate to": ('medium', None),
    'In essence': ('medium', ''),
    'In other words': ('medium', 'i.e.'),
    'Put simply': ('medium', ''),
    'Simply put': ('medium', ''),
    'To summarize': ('medium', ''),
    'To recap': ('medium', ''),
    'As you can see': ('medium', ''),
    'As we can see': ('medium', ''),
    'As mentioned earlier': ('medium', ''),
    'As noted above': ('medium', ''),
    'best practices': ('medium', 'good approaches'),
    'industry best practices': ('high', None),
    'state-of-the-art': ('medium', 'modern'),
    'cutting-edge technology': ('medium', 'modern tech'),
    'next-generation': ('medium', 'new'),
    'world-class': ('medium', ''),
    'enterprise-grade': ('medium', 'production-quality'),
    'production-ready solution': ('medium', 'working implementation'),
    'robust and scalable': ('medium', 'solid'),
    'flexible and extensible': ('medium', 'adaptable'),
    'powerful and intuitive': ('medium', ''),
    'clean and maintainable': ('medium', 'well-structured'),
    'modern and efficient': ('medium', 'fast'),
    "it's crucial to": ('medium', 'you should'),
    "it's essential to": ('medium', 'you need to'),
    "it's important to remember": ('medium', 'remember:'),
    "it's worth mentioning": ('medium', 'also,'),
    'importantly': ('medium', ''),
    'significantly': ('medium', ''),
    'notably': ('medium', ''),
    'interestingly': ('medium', ''),
    'in this context': ('medium', 'here'),
    'in this case': ('medium', 'here'),
    'in this scenario': ('medium', 'here'),
    'in this situation': ('medium', 'here'),
    'with that being said': ('medium', 'but'),
    'with that in mind': ('medium', 'so'),
    'given the above': ('medium', 'therefore'),
    'based on the above': ('medium', 'so'),
    'as a result of this': ('medium', 'so'),
    'due to the fact that': ('medium', 'because'),
    'for the purpose of': ('medium', 'to'),
    'in the context of': ('medium', 'in'),
    'with respect to': ('medium', 'regarding'),
    'in terms of': ('medium', 'regarding'),
    'when it comes to': ('medium', 'for'),
}

# Patterns of the comment recipe and their severities.
COMMENTS = {
    'verbose-function-doc': ('low', r'^\s*///?\s*(This|The)\s+(function|method|module|struct|enum|trait)\s+'),
    'helper-comment': ('low', r'^\s*///?\s*[Hh]elper\s+(function\s+)?(to|for|that)\s+'),
    'provides-comment': ('medium', r'^\s*///?\s*(Provides|Offers|Supplies)\s+(a\s+)?(comprehensive|streamlined|robust|ergonomic)'),
    'obvious-getter-doc': ('low', r'^\s*///?\s*Gets?\s+the\s+\w+\s*(of|for|from)?\s*(this|the)?\s*\w*\.?\s*$'),
    'obvious-setter-doc': ('low', r'^\s*///?\s*Sets?\s+the\s+\w+\s*(of|for|to)?\s*(this|the)?\s*\w*\.?\s*$'),
    'returns-self-doc': ('low', r'^\s*///?\s*[Rr]eturns\s+(a\s+)?(new\s+)?[Ss]elf\.?\s*$'),
    'creates-new-doc': ('low', r'^\s*///?\s*[Cc]reates?\s+(a\s+)?new\s+(instance\s+of\s+)?(this|the)?\s*\w*\.?\s*$'),
    'we-can-see': ('medium', r'^\s*///?\s*[Ww]e\s+can\s+see\s+that'),
    'note-that': ('low', r'^\s*///?\s*[Nn]ote\s+that\s+this'),
}

# Patterns for README files and their severities.
README = {
    'readme-emoji-header': ('medium', r'^#+.*[🚀🎯💡🔥✨⚡]'),
    'readme-features-header': ('low', r'^#+\s*(Key\s+)?Features'),
    'readme-badges-spam': ('low', r'\[!\[.*\]\(.*\)\].*\[!\[.*\]\(.*\)\].*\[!\[.*\]\(.*\)\]'),
}

# Fixed values: (threshold, lines of a bucket, severity of a cluster, confidence) of the recipes.
SCORING = {"slop-vocabulary": (4, 15, "high", 0.6), "phrase-patterns": (2, 30, "high", 0.8), "comment-patterns": (3, 20, "medium", 0.65)}
